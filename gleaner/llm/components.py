"""Connected components of a distributed edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import forget, written

_MOST_ROUNDS = 60
#: Edges up to which a round's smallest neighbours are sent to every executor; beyond, they are written before the join, so
#: that both sides are plain shuffles and a node of many edges is split.
SMALL_EDGES = 500_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())


def _joined(rows: DataFrame, least: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(least) if few else written(least, "least"), "u")


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    """Each node links its larger neighbours to the smallest of its neighbourhood; links may repeat."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _joined(both.filter("v > u"), least, few).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = _joined(down, least, few)
    moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node that an edge (u, v) of long ids names.

    Rounds are written to the shared folder; they are few, about the logarithm of the largest component's width.
    No group is gathered: a node with many edges is only summed over and joined.

    Loops and repeated edges, either way round, count once; rows with a null node are no edges; a node whose only edge is a loop
    isn't named; an empty table gives an empty result; extra columns are ignored.
    """
    edges = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(edges)
    for _ in range(_MOST_ROUNDS):
        if not before[0]:
            break
        few = before[0] <= SMALL_EDGES
        last, edges = edges, written(_small_star(_large_star(edges, few), few), "edges")
        forget(last)
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
