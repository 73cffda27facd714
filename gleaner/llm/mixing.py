"""Mixing sources to target weights, natively: a multivariate-hypergeometric splitting tree over blocks.

1.  ``targets``: sources get weights by rank and share a multiple of all words; a source stops at ``epochs`` times its
    own words and the excess is shared anew by weight (solved at once from the sorted caps, no iteration).
2.  A source's documents are dealt into at most ``BLOCKS`` blocks by hash.  Whole passes take every block; the rest of
    the target is filled along a random order of the blocks, each taken that still fits, and at last by the block that
    comes nearest to what is missing, if that is nearer than nothing.  A block taken twice is two draws, so a source has an exact quota of draws, and no document is cut.
3.  ``split_quotas``: the vector of quotas is split over the output shards by a binary tree.  A node gives its left half
    the draws that its shards hold; how many of them each source supplies is a multivariate-hypergeometric draw, made
    source by source by inversion of the exact distribution.  The right half gets the rest, so all quotas add up.
4.  ``plan``: each shard takes, by its quotas, a disjoint run of the source's permuted draws; a document has the shards of
    its block.  ``mix`` emits a row for each and orders every shard by hash, a local shuffle.

Only built-in functions run here.  The hash of all steps is seeded: reruns agree.

Edge cases: the size of a null text is 0; null sources are one source, the last; null or repeated ``doc_id`` are rows of
their own (equal rows share a block); an empty table gives empty results; a text of any length is counted whole; ``mix`` keeps
all columns of the documents and adds ``shard`` and ``copy``, as ``mix_shard`` and ``mix_copy`` where those names are taken.
Sources may be many, but their names, sizes and quotas are rows of one task: they are meant to be labels, not ids.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm.common import quoted, small, unused, written

WEIGHTS, SHARE, EPOCHS = (5, 2, 1), 1.5, 2
BLOCKS, SHARDS, SEED = 4096, 64, 17
#: Block rows up to which they are sent to every executor; more are joined by shuffle.
SMALL_BLOCKS = 200_000

WORD = r"[^\x20\x09-\x0D]+"


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _block_hash() -> Column:
    return F.xxhash64(F.lit(SEED), "doc_id", "tie")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Adds ``target`` to a row per source with its ``source_size`` (words).

    With level L, a source gets min(cap, weight * L).  Sources sorted by cap / weight are capped up to some rank; the
    level after the first k is (total - their caps) / (the other weights), and the first level below the next ratio holds.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    whole = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    df = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    df = df.withColumn("total", F.sum("source_size").over(whole) * share)
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights_left = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    df = df.withColumn("level", left / weights_left)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)["level"]
    return df.withColumn("target", F.least("cap", F.coalesce(F.col("weight") * level, F.col("cap")))).select("source", "source_size", "target")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed, and written into the plan, once."""
    return F.transform(F.array(value), use)[0]


def _lgamma(x: Column) -> Column:
    """ln gamma(x) for x >= 1, to about 1e-13: Stirling's series after a shift by 8."""
    shift = F.ln(x * (x + 1) * (x + 2) * (x + 3)) + F.ln((x + 4) * (x + 5) * (x + 6) * (x + 7))
    y = x + 8
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - shift


def hypergeometric(total: Column, marked: Column, drawn: Column, uniform: Column) -> Column:
    """How many of ``drawn`` out of ``total`` are marked, by inversion at ``uniform`` in [0, 1).

    The sum runs over 12 standard deviations around the mean; what lies outside weighs less than 1e-30.
    """

    def bounds(p: Column) -> Column:
        t, m, d = p["t"], p["m"], p["d"]
        mean, some = d * m / F.greatest(t, F.lit(1.0)), F.greatest(t, F.lit(1.0))
        spread = 12.0 * F.sqrt(mean * F.greatest(t - m, F.lit(0.0)) / some) + 12.0
        low = F.greatest(F.lit(0.0), d + m - t, F.floor(mean - spread).cast("double"))
        return F.struct(t.alias("t"), m.alias("m"), d.alias("d"), p["u"].alias("u"), low.alias("low"), F.least(m, d, F.ceil(mean + spread).cast("double")).alias("high"))

    def start(p: Column) -> Column:
        """ln of the probability of ``low``: three binomial coefficients, so nine factorials."""
        t, m, d, low = p["t"], p["m"], p["d"], p["low"]
        signs = ((m, 1), (low, -1), (m - low, -1), (t - m, 1), (d - low, -1), (t - m - d + low, -1), (t, -1), (d, 1), (t - d, 1))
        terms = F.transform(F.array(*[F.struct((x + 1.0).alias("x"), F.lit(float(g)).alias("g")) for x, g in signs]), lambda s: s["g"] * _lgamma(s["x"]))
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)

    def walk(p: Column) -> Column:
        def step(acc: Column, h: Column) -> Column:
            ratio = (p["m"] - h) * (p["d"] - h) / ((h + 1.0) * (p["t"] - p["m"] - p["d"] + h + 1.0))
            summed = acc["sum"] + F.exp(acc["ln"])
            return F.struct(
                (acc["ln"] + F.ln(F.greatest(ratio, F.lit(1e-300)))).alias("ln"),
                summed.alias("sum"),
                F.when((acc["at"] < 0) & (summed > p["u"]), h.cast("double")).otherwise(acc["at"]).alias("at"),
            )

        first = F.struct(start(p).alias("ln"), F.lit(0.0).alias("sum"), F.lit(-1.0).alias("at"))
        found = F.aggregate(F.sequence(p["low"].cast("long"), p["high"].cast("long")), first, step, lambda acc: acc["at"])
        return _let(found, lambda at: F.when(at < 0, p["high"]).otherwise(at).cast("long"))

    given = F.struct(total.cast("double").alias("t"), marked.cast("double").alias("m"), drawn.cast("double").alias("d"), uniform.alias("u"))
    return _let(_let(given, bounds), walk)


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """source, shard, n: the quotas (source, quota) split over ``shards`` shards of as equal size as can be.

    A row per tree node holds the vector of all sources; shards are parameters and sources few, so this is small.
    """
    node = quotas.agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", F.col("quota").alias("n")))).alias("q"))
    node = node.select("q", F.lit(0).alias("first"), F.lit(shards).alias("span"), F.lit(1).cast("long").alias("node"), F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("total"))

    def draw(acc: Column, x: Column) -> Column:
        uniform = F.pmod(F.xxhash64(F.lit(seed), F.col("node"), F.size(acc["out"])), F.lit(1 << 30)) / float(1 << 30)
        return _let(
            hypergeometric(acc["total"], x["n"], acc["drawn"], uniform),
            lambda n: F.struct((acc["total"] - x["n"]).alias("total"), (acc["drawn"] - n).alias("drawn"), F.concat(acc["out"], F.array(n)).alias("out")),
        )

    for _ in range(max(0, (shards - 1).bit_length())):
        half = F.ceil(F.col("span") / 2).cast("int")
        # The left half's draws: its shards' sizes, the first (total mod span) shards holding one more.
        size = F.floor(F.col("total") / F.col("span")) * half + F.least(F.col("total") % F.col("span"), half)
        start = F.struct(F.col("total").alias("total"), size.cast("long").alias("drawn"), F.array().cast("array<bigint>").alias("out"))
        draws = F.when(F.col("span") > 1, F.aggregate("q", start, draw, lambda acc: acc["out"]))
        # Exploding the one value makes the optimizer keep it, where it would repeat the draw for each use below.
        node = node.select("*", half.alias("half"), F.explode(F.array(draws)).alias("left"))
        left = F.transform("q", lambda x, i: F.struct(x["last"].alias("last"), x["source"].alias("source"), F.element_at("left", i + 1).alias("n")))
        right = F.transform("q", lambda x, i: F.struct(x["last"].alias("last"), x["source"].alias("source"), (x["n"] - F.element_at("left", i + 1)).alias("n")))
        sides = F.when(
            F.col("span") > 1,
            F.array(
                F.struct(left.alias("q"), F.col("first"), F.col("half").alias("span"), (F.col("node") * 2).alias("node")),
                F.struct(right.alias("q"), (F.col("first") + F.col("half")).alias("first"), (F.col("span") - F.col("half")).alias("span"), (F.col("node") * 2 + 1).alias("node")),
            ),
        ).otherwise(F.array(F.struct("q", "first", "span", "node")))
        node = node.select(F.explode(sides).alias("s")).select("s.*").withColumn("total", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    return node.select(F.explode("q").alias("x"), F.col("first").alias("shard")).select("x.source", "shard", "x.n")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, shards: int = SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, source, tie (hash of the text), size, source_size, target and the ``shards`` that take the document, repeats counted."""
    sized = written(docs.select("doc_id", "source", F.xxhash64("text").alias("tie"), words().alias("size")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    wanted = targets(sources.select("source", "source_size"), weights, share, epochs).join(F.broadcast(sources.select(F.col("source").alias("s"), "n")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    wanted = written(wanted.withColumn("n_blocks", F.least("n", F.lit(blocks))).drop("n"), "targets")
    # A row per source goes to every executor.
    own = F.broadcast(wanted.withColumnRenamed("source", "s")) if wanted.count() <= SMALL_BLOCKS else wanted.withColumnRenamed("source", "s")
    placed = sized.join(own, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("block", F.pmod(_block_hash(), F.col("n_blocks")))
    filled = placed.groupBy("source", "block").agg(F.sum("size").alias("n"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    draws = written(_draws(filled), "draws")
    quotas = draws.groupBy("source").agg(F.count(F.lit(1)).alias("quota"))
    runs = split_quotas(quotas, shards).withColumn("end", F.sum("n").over(Window.partitionBy("source").orderBy("shard")))
    runs = runs.filter("n > 0").select(F.col("source").alias("s"), "shard", (F.col("end") - F.col("n")).alias("begin"), "end")
    runs = runs.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("begin", "end", "shard"))).alias("runs"))
    at = F.filter("runs", lambda x: (x["begin"] <= F.col("place")) & (F.col("place") < x["end"]))[0]["shard"]
    taken = draws.join(F.broadcast(runs), F.col("source").eqNullSafe(F.col("s"))).withColumn("shard", at)
    taken = taken.groupBy("source", "block").agg(F.sort_array(F.collect_list("shard")).alias("shards"))
    taken = small(written(taken, "taken"), SMALL_BLOCKS).withColumnsRenamed({"source": "s", "block": "b"})
    out = placed.join(taken, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    return out.select("doc_id", "source", "tie", "size", "source_size", "target", F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))


def _draws(filled: DataFrame) -> DataFrame:
    """source, block, place: the draws of each source in a permuted order.  A source has at most ``BLOCKS`` rows here."""
    per = filled.groupBy("source", "source_size", "target").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(SEED + 1), "block").alias("h"), "block", "n"))).alias("bs"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    per = per.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))

    def take(acc: Column, x: Column) -> Column:
        fits = x["n"] <= acc["rest"]
        return F.struct(
            F.when(fits, acc["rest"] - x["n"]).otherwise(acc["rest"]).alias("rest"),
            F.concat(acc["out"], F.when(fits & (x["n"] > 0), F.array(x["block"])).otherwise(F.array().cast("array<bigint>"))).alias("out"),
        )

    def filled_up(acc: Column) -> Column:
        fits = F.filter("bs", lambda x: (x["n"] > 0) & (x["n"] < 2 * acc["rest"]) & ~F.array_contains(acc["out"], x["block"]))
        nearest = F.array_min(F.transform(fits, lambda x: F.struct(F.abs(acc["rest"] - x["n"]).alias("off"), x["block"].alias("block"))))
        return F.concat(acc["out"], F.when(nearest.isNotNull(), F.array(nearest["block"])).otherwise(F.array().cast("array<bigint>")))

    extra = F.aggregate("bs", F.struct(F.col("rest").alias("rest"), F.array().cast("array<bigint>").alias("out")), take, filled_up)
    passes = F.flatten(F.transform("bs", lambda x: F.when(F.col("whole") > 0, F.array_repeat(x["block"], F.col("whole"))).otherwise(F.array().cast("array<bigint>"))))
    rows = per.select("source", F.posexplode(F.concat(passes, extra)).alias("k", "block"))
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(SEED + 2), "block", "k"), "k")
    return rows.select("source", "block", (F.row_number().over(order) - 1).alias("place"))


def mix(docs: DataFrame, planned: DataFrame | None = None, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, once for each draw, with ``shard`` and ``copy``; shards are shuffled by hash.

    Rows are joined to their plan by doc_id, source and text, so whole repeated rows share one plan."""
    planned = plan(docs, **options) if planned is None else planned
    names = {c.lower() for c in docs.columns}
    shard, copy = (c if c not in names else f"mix_{c}" if f"mix_{c}" not in names else unused(docs, f"mix_{c}") for c in ("shard", "copy"))
    own_id, own_source, own_tie = (unused(docs, f"mix_{c}") for c in ("id", "source", "tie"))
    rows = planned.groupBy("doc_id", "source", "tie").agg(F.first("shards").alias("shards"))
    rows = rows.select(F.col("doc_id").alias(own_id), F.col("source").alias(own_source), F.col("tie").alias(own_tie), F.posexplode("shards").alias(copy, shard))
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & F.col("source").eqNullSafe(F.col(own_source)) & (F.xxhash64("text") == F.col(own_tie))
    out = docs.join(rows, same).select(*[docs[quoted(c)] for c in docs.columns], shard, copy)
    return out.repartition(shard, F.pmod(F.xxhash64("doc_id"), F.lit(64))).sortWithinPartitions(shard, F.xxhash64(F.lit(SEED + 3), "doc_id", copy))


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and ``taken`` of every row of ``docs``: its words in the rows that ``mix`` emits.

    What is emitted for whole repeated rows is shared among them; a remainder would go to the first of them."""
    planned = plan(docs, **options)
    # The place in the output keeps the optimizer from leaving out the order of the shards.
    mixed = mix(docs.select("doc_id", "source", "text"), planned).select("doc_id", "source", F.xxhash64("text").alias("tie"), words().alias("n"), F.monotonically_increasing_id().alias("at"))
    emitted = mixed.groupBy("doc_id", "source", "tie").agg(F.sum(F.when(F.col("at") >= 0, F.col("n"))).alias("n")).withColumnsRenamed({"doc_id": "d", "source": "s", "tie": "t"})
    rows = planned.groupBy("doc_id", "source", "tie").agg(F.count(F.lit(1)).alias("m"), *[F.first(c).alias(c) for c in ("size", "source_size", "target")])
    both = rows.join(emitted, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("tie") == F.col("t")), "left")
    n = F.coalesce("n", F.lit(0))
    each = both.select("doc_id", "size", "source_size", "target", n.alias("n"), "m", F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("k"))
    share = F.floor(F.col("n") / F.col("m")) + F.when(F.col("k") <= F.col("n") % F.col("m"), 1).otherwise(0)
    return each.select("doc_id", "size", "source_size", "target", share.cast("long").alias("taken"))
