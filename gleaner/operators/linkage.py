"""Average-linkage clustering of places of any size, by rounds of reciprocal nearest neighbours.

The mean cosine distance of two clusters is 1 less the product of their mean unit vectors, and a merge never brings a third
cluster nearer than its parts were.  So all pairs that are each other's nearest can merge at once, and the clusters below a
threshold are those of merging one pair at a time.  A round finds nearest neighbours by products of blocks of mean vectors, for
the clusters alone whose neighbour has gone; clusters whose nearest is not below the threshold are final and leave.  A place that
has shrunk to ``few`` clusters is finished in one task, whose input that bounds.

Distances that differ by less than 1e-12 are equal; of equal ones a hash of the pair decides, the same for both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.operators.vectors import MERGE_CAP, linked_means, merge_by_anchor, normalize, usable_anchor
from gleaner.storage import Steps

#: Clusters of a block at least and at most, blocks of a place while they hold no more, and rounds at most.  Each block meets
#: each, so what a round shuffles is the place times the number of blocks, whatever the place's size.
BLOCK, MOST_BLOCK, BLOCKS, ROUNDS = 1024, 32_768, 16, 400
#: Distances that a task holds at once.
CELL = 1 << 21
_DIGITS = 12


def _blocks(clusters: DataFrame, sizes: DataFrame, block: int, side: str) -> DataFrame:
    """A row for each block of a place's clusters: their ids and mean vectors."""
    n = F.least(F.ceil(F.col("n_alive") / block), F.greatest(F.lit(BLOCKS), F.ceil(F.col("n_alive") / MOST_BLOCK))).cast("int")
    rows = clusters.join(F.broadcast(sizes), "place").withColumns({"n_blocks": n, "block": F.pmod(F.xxhash64("cluster"), n).cast("int")})
    return rows.groupBy("place", "block", "n_blocks").agg(F.collect_list(F.struct("cluster", "mean")).alias("x")).select("place", "block", "n_blocks", F.col("x.cluster").alias(f"{side}_ids"), F.col("x.mean").alias(f"{side}_means"))


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of unordered pairs, not negative."""
    low, high = np.minimum(a, b).astype(np.uint64), np.maximum(a, b).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(1)).astype(np.int64)


def _nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            ids, other = np.asarray(r.q_ids, np.int64), np.asarray(r.c_ids, np.int64)
            means, others = np.stack(r.q_means), np.stack(r.c_means).T
            step = max(1, CELL // len(other))
            for start in range(0, len(ids), step):
                own = ids[start : start + step]
                d = np.round(1.0 - means[start : start + step] @ others, _DIGITS)
                d[own[:, None] == other[None, :]] = np.inf
                least = d.min(axis=1)
                at = d.argmin(axis=1)
                for k in np.flatnonzero((d == least[:, None]).sum(axis=1) > 1):
                    tied = np.flatnonzero(d[k] == least[k])
                    at[k] = tied[np.argmin(_pair_key(np.full(len(tied), own[k]), other[tied]))]
                found = np.isfinite(least)
                yield pd.DataFrame({"place": r.place, "cluster": own[found], "dist": least[found], "tie": _pair_key(own, other[at])[found], "near": other[at][found]})


def _finish(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster")
        ids = pdf["cluster"].to_numpy()
        root = linked_means(np.stack(pdf["mean"]), pdf["size"].to_numpy(np.float64), threshold)
        return pd.DataFrame({"place": pdf["place"], "old": ids, "new": ids[root]})

    return run


def link(df: DataFrame, place: str, idx: str, vector: str, threshold: float, few: int, block: int = BLOCK) -> DataFrame:
    """place, idx and ``cluster``, the smallest idx of its cluster, of every row (each idx once in its place, none null)."""
    steps = Steps(df.sparkSession, "linkage")
    rows = steps.written(df.select(F.col(place).alias("place"), F.col(idx).cast("long").alias("idx"), normalize(F.col(vector)).alias("mean")))
    # Equal vectors are one cluster from the start.
    alive = steps.written(rows.groupBy("place", "mean").agg(F.min("idx").alias("cluster"), F.count(F.lit(1)).cast("double").alias("size")))
    first = alive.withColumnsRenamed({"place": "p", "mean": "m", "cluster": "old"}).select("p", "m", "old")
    members = rows.join(first, F.col("place").eqNullSafe(F.col("p")) & (F.col("mean") == F.col("m"))).select("place", "idx", F.col("old").alias("cluster"))
    root = steps.written(members)
    known = df.sparkSession.createDataFrame([], "place string, cluster long, dist double, tie long, near long")
    key = ["place", "cluster"]

    def moved(root: DataFrame, moves: DataFrame) -> DataFrame:
        return root.join(moves.withColumnRenamed("old", "cluster"), key, "left").select("place", "idx", F.coalesce("new", "cluster").alias("cluster"))

    for _ in range(ROUNDS):
        # A row a place; places that are small by now are finished.
        sizes = steps.written(alive.groupBy("place").agg(F.count(F.lit(1)).alias("n_alive")))
        done = alive.join(F.broadcast(sizes.filter(F.col("n_alive") <= few).select("place")), "place", "left_semi")
        root = steps.written(moved(root, done.groupBy("place").applyInPandas(_finish(threshold), "place string, old long, new long")))
        sizes = sizes.filter(F.col("n_alive") > few)
        if sizes.isEmpty():
            return root.withColumnsRenamed({"place": place, "idx": idx})
        alive = alive.join(F.broadcast(sizes.select("place")), "place", "left_semi")
        asking = alive.join(known.select(*key), key, "left_anti")
        q = _blocks(asking, sizes, block, "q").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).drop("n_blocks")
        c = _blocks(alive, sizes, block, "c").drop("n_blocks")
        found = c.join(q, ["place", "block"]).mapInPandas(_nearest, "place string, cluster long, dist double, tie long, near long")
        best = found.groupBy(*key).agg(F.min(F.struct("dist", "tie", "near")).alias("b")).select(*key, "b.*")
        near = steps.written(known.join(sizes.select("place"), "place", "left_semi").unionByName(best).filter(F.col("dist") < threshold))
        # Pairs that are each other's nearest; else the nearest pair of all, which always may merge.
        back = near.select("place", F.col("cluster").alias("near"), F.col("near").alias("cluster"))
        pairs = steps.written(near.join(back, ["place", "cluster", "near"], "left_semi").filter("cluster < near").select("place", F.col("cluster").alias("a"), F.col("near").alias("b")))
        if pairs.isEmpty():
            least = near.groupBy("place").agg(F.min(F.struct("dist", "tie", F.least("cluster", "near").alias("a"), F.greatest("cluster", "near").alias("b"))).alias("x"))
            pairs = steps.written(least.select("place", "x.a", "x.b"))
        moves = pairs.select("place", F.col("b").alias("old"), F.col("a").alias("new"))
        root = steps.written(moved(root, moves))
        gone = steps.written(pairs.select("place", F.explode(F.array("a", "b")).alias("cluster")))
        grouped = pairs.select("place", F.posexplode(F.array("a", "b")).alias("k", "cluster"), "a").join(alive, key)
        total = F.sum("size")
        part = grouped.select("place", "a", "size", F.posexplode("mean").alias("i", "x")).groupBy("place", "a", "i").agg((F.sum(F.col("size") * F.col("x")) / total).alias("x"), total.alias("size"))
        merged = part.groupBy("place", "a").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"), F.first("size").alias("size")).select("place", F.col("v.x").alias("mean"), F.col("a").alias("cluster"), "size")
        # Clusters without a neighbour below the threshold are final.
        stay = alive.join(near.select(*key), key, "left_semi").join(gone, key, "left_anti")
        alive = steps.written(stay.unionByName(merged))
        kept = near.join(gone, key, "left_anti").join(gone.withColumnRenamed("cluster", "near"), ["place", "near"], "left_anti")
        known = steps.written(kept.select("place", "cluster", "dist", "tie", "near"))
    raise RuntimeError("linkage did not settle")


def _connected(rows: DataFrame, steps: Steps) -> DataFrame:
    """place, cluster, and ``team``, the least cluster that shared anchors connect it with; rows are (place, cluster, anchor)."""
    rows = steps.written(rows.distinct())
    label = steps.written(rows.select("place", "cluster").distinct().withColumn("team", F.col("cluster")))
    before = None
    while (now := label.agg(F.sum(F.col("team").cast("decimal(38,0)"))).head()[0]) != before:
        before = now
        spread = rows.join(label, ["place", "cluster"])
        least = spread.groupBy("place", "anchor").agg(F.min("team").alias("least"))
        label = steps.written(spread.join(least, ["place", "anchor"]).groupBy("place", "cluster").agg(F.min("least").alias("team")))
    return label


def _merge_team(pdf: pd.DataFrame) -> pd.DataFrame:
    """The clusters of one team after merging; a cluster is named by its least member."""
    pdf = pdf.sort_values("idx").reset_index(drop=True)
    x = np.stack([np.asarray(v, np.float64) for v in pdf["vector"]])
    groups = sorted((g.tolist() for g in pdf.groupby("cluster", sort=True).indices.values()), key=lambda g: (-len(g), g[0]))
    merged = merge_by_anchor(groups, x, pdf["anchor"].tolist())
    cluster = np.zeros(len(pdf), np.int64)
    for g in merged:
        cluster[g] = pdf["idx"].to_numpy()[min(g)]
    return pd.DataFrame({"place": pdf["place"], "idx": pdf["idx"], "cluster": cluster})


def link_and_merge(df: DataFrame, place: str, idx: str, vector: str, anchor: str, threshold: float, merge: bool, few: int) -> DataFrame:
    """place, n_in_place, member_indices and size of the clusters of large places, merged by anchor if asked.

    Only clusters below the cap of a merged one and with an anchor of another such cluster can merge; those that anchors connect
    are one task's."""
    steps = Steps(df.sparkSession, "merging")
    linked = link(df, place, idx, vector, threshold, few).select(F.col(place).alias("place"), F.col(idx).alias("idx"), "cluster")
    linked = steps.written(linked)
    if merge:
        named = df.select(F.col(place).alias("place"), F.col(idx).cast("long").alias("idx"), F.col(vector).alias("vector"), F.col(anchor).alias("anchor"))
        sizes = linked.groupBy("place", "cluster").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < MERGE_CAP).select("place", "cluster")
        own = linked.join(named, ["place", "idx"]).join(sizes, ["place", "cluster"], "left_semi")
        team = _connected(own.select("place", "cluster", usable_anchor(F.col("anchor")).alias("anchor")).filter("anchor IS NOT NULL"), steps)
        several = team.groupBy("place", "team").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("place", "team")
        team = team.join(several, ["place", "team"], "left_semi")
        merged = own.join(team, ["place", "cluster"]).groupBy("place", "team").applyInPandas(_merge_team, "place string, idx long, cluster long")
        merged = steps.written(merged.withColumnRenamed("cluster", "new"))
        linked = linked.join(merged, ["place", "idx"], "left").select("place", "idx", F.coalesce("new", "cluster").alias("cluster"))
    groups = linked.groupBy("place", "cluster").agg(F.array_sort(F.collect_list("idx")).alias("member_indices"), F.count(F.lit(1)).cast("int").alias("size"))
    order = Window.partitionBy("place").orderBy(F.desc("size"), "cluster")
    return groups.withColumn("n_in_place", F.row_number().over(order) - 1).withColumnRenamed("place", place)
