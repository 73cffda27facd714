"""Top-k, quotas and stratified samples as windows; ties are always broken by given columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def newest(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    """Top k by a column, nulls first as in a descending sort of the store."""
    return df.orderBy(F.desc_nulls_first(by), tie).limit(k)


def overfetch(df: DataFrame, by: str, tie: str, passes: Column, target: int, factor: int) -> DataFrame:
    """The first ``target`` passing rows among the first ``factor * target``: two limits that must not be merged."""
    return newest(df, by, factor * target, tie).filter(passes).orderBy(F.desc_nulls_first(by), tie).limit(target)


def quota(df: DataFrame, group: list[str], quotas: DataFrame, band: str, by: str, tie: str) -> DataFrame:
    """The best rows of each group and band, as many as the band's quota (band, n)."""
    rn = F.row_number().over(Window.partitionBy(*group, band).orderBy(F.desc_nulls_first(by), tie))
    return df.join(F.broadcast(quotas), band).withColumn("_rn", rn).filter(F.col("_rn") <= F.col("n")).drop("_rn", "n")


def bands(df: DataFrame, value: str, groups: list[list[int]], each: int, tie: str) -> DataFrame:
    """The first rows by id of each band of values, with the band's number; values of no band go."""
    band = F.coalesce(*[F.when(F.col(value).isin(g), F.lit(k)) for k, g in enumerate(groups)])
    rn = F.row_number().over(Window.partitionBy("band").orderBy(tie))
    return df.withColumn("band", band).filter("band IS NOT NULL").withColumn("_rn", rn).filter(F.col("_rn") <= each).drop("_rn")


def round_robin(df: DataFrame, group: str, order: str, target: int) -> DataFrame:
    """One row of each group in turn, groups by first appearance, until there are ``target``."""
    rn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    seen = F.min(order).over(Window.partitionBy(group))
    return df.withColumns({"turn": rn, "_seen": seen}).orderBy("turn", "_seen").limit(target).drop("_seen")


def first_middle_last(chunks: Column) -> Column:
    """Those three of at least three chunks, else none."""
    n = F.size(chunks)
    return F.when(n >= 3, F.filter(chunks, lambda c, i: (i == 0) | (i == F.floor(n / 2)) | (i == n - 1))).otherwise(F.slice(chunks, 1, 0))


def top_per_group(df: DataFrame, group: list[str], by: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*by))).filter(F.col(rank) <= k)


def most_common(df: DataFrame, group: list[str], value: str, order: str, k: int) -> DataFrame:
    """The k commonest values of each group, ties by first appearance."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))
    return top_per_group(counts, group, [F.desc("n"), F.asc("first_seen")], k).drop("first_seen")


def batches(df: DataFrame, order: str, size: int, group: list[str]) -> DataFrame:
    """Batch numbers of ``size`` rows each within a group."""
    rn = F.row_number().over(Window.partitionBy(*group).orderBy(order))
    return df.withColumn("batch", F.floor((rn - 1) / size))


def argmax(df: DataFrame, group: list[str], row: Column, by: Column) -> DataFrame:
    return df.groupBy(*group).agg(F.max_by(row, by).alias("best"))


def sections(clusters: DataFrame, order: dict[str, int], per: int = 6, least: int = 20) -> DataFrame:
    """The largest good clusters of each l1 that has more than ``least``, in a fixed order of l1."""
    total = F.count(F.lit(1)).over(Window.partitionBy("l1"))
    good = clusters.withColumn("_n", total).filter(F.col("_n") > least).filter("quality_tier = 'A' OR quality_tier IS NULL")
    place = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("l1"))
    return top_per_group(good, ["l1"], [F.desc("size"), F.asc("cluster_id")], per).withColumn("section", place).drop("_n").orderBy("section", "rank")
