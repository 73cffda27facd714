"""First-wins and last-wins dedupe, upserts, links, deletes and constraints over plain tables.

Row order is never relied on: each operator takes the columns that say what comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_wins(df: DataFrame, keys: list[str | Column], order: list[str | Column], drop_empty: bool = False) -> DataFrame:
    """The first row of each key; rows with a null or empty key go if asked."""
    named = [k for k in keys if isinstance(k, str)]
    if drop_empty:
        for k in named:
            df = df.filter(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def last_wins(df: DataFrame, keys: list[str | Column], order: list[str]) -> DataFrame:
    return first_wins(df, keys, [F.desc(c) for c in order])


def upsert(existing: DataFrame, batch: DataFrame, key: list[str], sequence: str) -> DataFrame:
    """Rows of ``batch`` overwrite those of equal key, the last of the batch's; columns it lacks keep their values.

    A full outer join on the key: one shuffle of either side, none if both are bucketed by it."""
    new = last_wins(batch, list(key), [sequence])
    given = [c for c in new.columns if c in existing.columns and c not in key]
    side = new.select(*[F.col(k).alias(f"_k_{k}") for k in key], *[F.col(c).alias(f"_n_{c}") for c in given], F.lit(True).alias("_new"))
    on = None
    for k in key:
        same = F.col(k) == F.col(f"_k_{k}")
        on = same if on is None else on & same
    both = existing.join(side, on, "full_outer")
    cols = []
    for c in existing.columns:
        if c in key:
            cols.append(F.coalesce(F.col(f"_k_{c}"), F.col(c)).alias(c))
        elif c in given:
            cols.append(F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return both.select(*cols)


def insert_new(existing: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Existing rows and those of the batch whose key is new, each once; null key parts are equal."""
    fresh = batch.dropDuplicates(key)
    on = None
    for k in key:
        same = F.col(f"b.{k}").eqNullSafe(F.col(f"e.{k}"))
        on = same if on is None else on & same
    return existing.unionByName(fresh.alias("b").join(existing.alias("e"), on, "left_anti").select(*existing.columns))


def surrogate(*natural: str) -> Column:
    """A deterministic id of a natural key."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in natural]), 256)


def upsert_returning(existing: DataFrame, batch: DataFrame, key: str, sequence: str) -> tuple[DataFrame, DataFrame]:
    """The merged table, and (key, id) of the batch's rows."""
    merged = upsert(existing, batch.withColumn("id", surrogate(key)), [key], sequence)
    return merged, batch.select(key, surrogate(key).alias("id")).distinct()


def delete_cascade(parents: DataFrame, children: DataFrame, ids: DataFrame, key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the rows of the given ids, children first."""
    gone = ids.select(F.col(key).alias("_gone")).distinct()
    return parents.join(gone, F.col(key) == F.col("_gone"), "left_anti"), children.join(gone, F.col(child_key) == F.col("_gone"), "left_anti")


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Column defaults: absent columns are added, nulls filled."""
    return df.withColumns({c: F.coalesce(F.col(c), v) if c in df.columns else v for c, v in defaults.items()})


def validate(df: DataFrame, rules: dict[str, Column], unique: list[str] | None = None, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that hold all rules, and the others with the ``violations`` they break.

    A rule that is null passes, as a CHECK does; of rows that share a unique key all but the first break ``unique``."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(r, F.lit(True)), F.lit(n)) for n, r in rules.items()])) if rules else F.array().cast("array<string>")
    df = df.withColumn("violations", broken)
    if unique:
        again = F.row_number().over(Window.partitionBy(*unique).orderBy(*(order or unique))) > 1
        df = df.withColumn("violations", F.when(again, F.array_append("violations", F.lit("unique"))).otherwise(F.col("violations")))
    return df.filter(F.size("violations") == 0).drop("violations"), df.filter(F.size("violations") > 0)


def cursor_of(wanted: DataFrame, cursors: DataFrame, key: list[str], defaults: dict[str, Column]) -> DataFrame:
    """Each wanted key with its stored state, or the defaults."""
    return wanted.join(cursors, key, "left").select(*key, *[F.coalesce(F.col(c), v).alias(c) for c, v in defaults.items()])
