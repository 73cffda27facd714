"""Vector operators: cosine, centroids, average-linkage clustering with anchor merging, and diversity reranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPSILON = 1e-9
DISTANCE_V1, DISTANCE, MERGE_DISTANCE, MERGE_CAP, COHERENCE = 0.35, 0.28, 0.25, 150, 0.45
MMR_LAMBDA, MMR_GAP = 0.85, 0.05
#: Anchors too general to tell clusters apart.
GENERIC_ANCHORS = ["colosseum", "the colosseum", "louvre", "louvre museum", "the louvre", "rome", "paris"]
#: Insights of one place up to which all distances are kept; the matrix grows with the square.
MOST_A_PLACE = 8_000
#: Distances that differ by less count as equal where they are computed anew.
SAME = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """v divided by its length (and a hair, so that zero stays zero)."""
    return F.transform(v, lambda x: x.cast("double") / (norm(v) + EPSILON))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + EPSILON) * (norm(b) + EPSILON))


def centroids(df: DataFrame, group: list[str], vector: str) -> DataFrame:
    """The normalized mean vector of each group: sums by coordinate, combined before the shuffle."""
    parts = df.select(*group, F.posexplode(vector).alias("i", "x"))
    means = parts.groupBy(*group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).select(*group, normalize(F.col("c.m")).alias("centroid"))


def nearest_centroid(df: DataFrame, group: list[str], vector: str, tie: str, k: int = 5) -> DataFrame:
    """The k members of each group nearest to its centroid."""
    near = df.join(centroids(df, group, vector), group).withColumn("similarity", F.round(dot(normalize(F.col(vector)), F.col("centroid")), 9))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("similarity"), tie))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).drop("centroid")


def _merges(x: np.ndarray) -> list[tuple[float, int, int]]:
    """Height and the two least rows of every merge, from the matrix of distances with the Lance-Williams mean update."""
    n = len(x)
    unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + EPSILON)
    d = 1.0 - unit @ unit.T
    np.fill_diagonal(d, np.inf)
    size, alive, merges, chain = np.ones(n), np.ones(n, bool), [], []
    while alive.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        top = chain[-1]
        row = np.where(alive, d[top], np.inf)
        best = int(np.argmin(row))
        if len(chain) > 1 and row[chain[-2]] <= row[best]:
            best = chain[-2]
        if len(chain) > 1 and best == chain[-2]:
            a, b = sorted((chain.pop(), chain.pop()))
            merges.append((row[best], a, b))
            mean = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
            d[a, :], d[:, a] = mean, mean
            d[a, a] = np.inf
            size[a] += size[b]
            alive[b] = False
        else:
            chain.append(best)
    return merges


def _merges_by_mean(x: np.ndarray, threshold: float, size: np.ndarray | None = None) -> list[tuple[float, int, int]]:
    """The merges below the threshold without the matrix: the mean cosine distance of two clusters is 1 less the product of
    their mean unit vectors, so memory is that of the vectors.

    With ``size`` the rows are mean unit vectors of so many.  A cluster whose nearest is not below the threshold is final, as no merge brings others nearer than their parts were."""
    mean, size = (x / (np.linalg.norm(x, axis=1, keepdims=True) + EPSILON), np.ones(len(x))) if size is None else (x.copy(), size.copy())
    ids, alive = np.arange(len(mean)), np.ones(len(mean), bool)
    merges, chain, left = [], [], len(mean)
    while left > 1:
        if not chain:
            if 2 * left < len(ids):
                mean, ids, size, alive = mean[alive], ids[alive], size[alive], np.ones(left, bool)
            chain = [int(np.argmax(alive))]
        top = chain[-1]
        row = np.where(alive, 1.0 - mean @ mean[top], np.inf)
        row[top] = np.inf
        best = int(np.argmin(row))
        if len(chain) > 1 and row[chain[-2]] <= row[best] + SAME:
            best = chain[-2]
            a, b = sorted((chain.pop(), chain.pop()))
            merges.append((row[best], int(ids[a]), int(ids[b])))
            mean[a] = (size[a] * mean[a] + size[b] * mean[b]) / (size[a] + size[b])
            size[a] += size[b]
            alive[b] = False
            left -= 1
        elif row[best] >= threshold + SAME:
            alive[chain.pop()] = False
            left -= 1
        else:
            chain.append(best)
    return merges


def average_linkage(x: np.ndarray, threshold: float) -> list[list[int]]:
    """Agglomerative clusters of rows by mean cosine distance, merged while the least is below the threshold.

    Nearest-neighbour chains: merge heights of this linkage never fall along the chain, so cutting afterwards gives the
    clusters of the greedy order.  Above ``MOST_A_PLACE`` rows distances are computed where they are needed."""
    n = len(x)
    root = _roots(n, _merges(x) if n <= MOST_A_PLACE else _merges_by_mean(x, threshold), threshold)
    groups: dict[int, list[int]] = {}
    for i in range(n):
        groups.setdefault(root[i], []).append(i)
    return list(groups.values())


def linked_means(mean: np.ndarray, size: np.ndarray, threshold: float) -> list[int]:
    """The least row of its cluster for each row, which stands for ``size`` unit vectors of that mean."""
    return _roots(len(mean), _merges_by_mean(mean, threshold, size), threshold)


def _roots(n: int, merges: list[tuple[float, int, int]], threshold: float) -> list[int]:
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for height, a, b in merges:
        if height < threshold:
            i, j = find(a), find(b)
            root[max(i, j)] = min(i, j)
    return [find(i) for i in range(n)]


class _Group:
    def __init__(self, members: list[int], anchors: set[str], x: np.ndarray):
        self.members, self.anchors = members, anchors
        mean = x[members].mean(axis=0)
        self.centre = mean / (np.linalg.norm(mean) + EPSILON)

    def takes(self, other: _Group, x: np.ndarray) -> _Group | None:
        """The union with another group, if anchors are shared and it is near, small and coherent enough."""
        if not self.anchors & other.anchors or 1.0 - self.centre @ other.centre >= MERGE_DISTANCE or len(self.members) + len(other.members) > MERGE_CAP:
            return None
        both = _Group(self.members + other.members, self.anchors | other.anchors, x)
        return both if 1.0 - (x[both.members] @ both.centre).min() <= COHERENCE else None


def merge_by_anchor(groups: list[list[int]], x: np.ndarray, anchors: list[str | None]) -> list[list[int]]:
    """Groups in order of size absorb later ones until a whole pass changes nothing; an absorbed group counts at once."""
    own = [_Group(g, {a for a in ((anchors[i] or "").strip().lower() for i in g) if a and a not in GENERIC_ANCHORS}, x) for g in groups]
    before = -1
    while before != len(own):
        before, k = len(own), 0
        centres, sizes, alive = np.array([g.centre for g in own]), np.array([len(g.members) for g in own]), np.ones(len(own), bool)
        while k < len(own):
            at = k + 1
            while alive[k] and at < len(own):
                # Only those near and small enough can be taken; ``takes`` decides.
                near = alive[at:] & (sizes[at:] + len(own[k].members) <= MERGE_CAP)
                near &= 1.0 - centres[at:] @ own[k].centre < MERGE_DISTANCE + EPSILON
                for i in np.flatnonzero(near) + at:
                    both = own[k].takes(own[i], x)
                    if both is not None:
                        own[k], alive[i] = both, False
                        break
                else:
                    break
                at = i + 1
            k += 1
        own = [g for g, kept in zip(own, alive, strict=True) if kept]
    return [g.members for g in own]


def usable_anchor(anchor: Column) -> Column:
    """An anchor in lower case, if it can tell clusters apart; else null."""
    low = F.lower(F.trim(anchor))
    return F.when((low != "") & ~low.isin(GENERIC_ANCHORS), low)


def cluster_places(df: DataFrame, place: str = "poi_name", idx: str = "flat_idx", vector: str = "embedding", anchor: str = "anchor_entity", threshold: float = DISTANCE, merge: bool = True, most: int = MOST_A_PLACE) -> DataFrame:
    """place, members and size of the clusters of each place, the largest first (``n_in_place``).

    A place of up to ``most`` insights is clustered in one task.  Larger ones are linked in rounds over many tasks, and merged
    by anchor in groups of the small clusters that anchors connect, with the same clusters; of equal size that of the smallest
    member comes first there.  Places are counted at once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx).reset_index(drop=True)
        x = np.stack([np.asarray(v, np.float64) for v in pdf[vector]])
        groups = sorted(average_linkage(x, threshold) if len(x) > 1 else [[0]], key=lambda g: -len(g))
        if merge:
            groups = sorted(merge_by_anchor(groups, x, pdf[anchor].tolist()), key=lambda g: -len(g))
        ids = pdf[idx].to_numpy()
        return pd.DataFrame({place: pdf[place].iloc[0], "n_in_place": range(len(groups)), "member_indices": [ids[g].tolist() for g in groups], "size": [len(g) for g in groups]})

    shape = f"{place} {df.schema[place].dataType.simpleString()}, n_in_place int, member_indices array<bigint>, size int"
    rows = df.select(place, idx, vector, anchor)
    large = rows.groupBy(place).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(place)
    large = df.sparkSession.createDataFrame(large.toPandas(), large.schema)  # places of over ``most`` insights: names alone
    if large.isEmpty():
        return rows.groupBy(place).applyInPandas(run, shape)
    from gleaner.operators.linkage import link_and_merge

    small = rows.join(F.broadcast(large), place, "left_anti").groupBy(place).applyInPandas(run, shape)
    return small.unionByName(link_and_merge(rows.join(F.broadcast(large), place), place, idx, vector, anchor, threshold, merge, most).select(*small.columns))


def number_clusters(clusters: DataFrame, flat: DataFrame, place: str = "poi_name", idx: str = "flat_idx") -> DataFrame:
    """Running cluster ids: places by first appearance, each place's clusters in their order.

    Offsets come from one row per place, so no window spans all clusters."""
    first = flat.groupBy(place).agg(F.min(idx).alias("seen"))
    n = clusters.groupBy(place).agg(F.count(F.lit(1)).alias("n")).join(first, place)
    start = F.sum("n").over(Window.orderBy("seen").rowsBetween(Window.unboundedPreceding, -1))
    offsets = n.select(place, F.coalesce(start, F.lit(0)).alias("start"))
    return clusters.join(F.broadcast(offsets), place).withColumn("cluster_id", F.col("start") + F.col("n_in_place")).drop("start", "n_in_place")


def select_diverse(scores: np.ndarray, vectors: np.ndarray, limit: int, weight: float = MMR_LAMBDA, gap: float = MMR_GAP) -> list[int]:
    """Positions of the chosen candidates: by relevance, unless the two best are close; then every further one maximizes
    relevance less likeness to those chosen, the best staying first."""
    order = np.argsort(-scores, kind="stable")
    if len(order) < 2 or limit <= 1 or scores[order[0]] - scores[order[1]] >= gap:
        return order[: max(1, limit)].tolist()
    chosen, rest = [int(order[0])], [int(i) for i in order[1:]]
    while rest and len(chosen) < limit:
        like = (vectors[rest] @ vectors[chosen].T).max(axis=1)
        chosen.append(rest.pop(int(np.argmax(weight * scores[rest] - (1 - weight) * like))))
    return chosen


def rerank_diverse(df: DataFrame, group: str, score: str, vector: str, tie: str, limit: int) -> DataFrame:
    """``select_diverse`` for each query of a bounded pool of candidates; adds ``rank``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, tie], ascending=[False, True]).reset_index(drop=True)
        chosen = select_diverse(pdf[score].to_numpy(), np.stack([np.asarray(v, np.float64) for v in pdf[vector]]), limit)
        return pdf.iloc[chosen].assign(rank=range(1, len(chosen) + 1))

    return df.groupBy(group).applyInPandas(run, df.schema.simpleString()[7:-1] + ",rank:int")
