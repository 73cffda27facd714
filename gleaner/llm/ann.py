"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

Largest inner product becomes smallest distance by one more coordinate, ``sqrt(M^2 - |v|^2)`` with M the largest norm.
The tree is fitted on a bounded sample (``Params.sample`` vectors by hash); every vector is then filed under the leaf that
its descent reaches, in a written table whose large leaves are split into parts.  A query walks the tree through a
priority queue keyed by the distance to the nodes' centres, always opening the nearest; it visits leaves in that order.
How many it visits is calibrated: two bounded sets of queries are answered exactly against all vectors; visits widen step
by step until the first set's recall reaches the target and the second set, which did not choose them, has ``least`` (every
leaf, at the widest).  A query whose leaves hold fewer than k candidates widens further by itself.  Visited (query, part)
pairs are joined, scored in matrix blocks, and reduced to the best k, ties to the smaller id; scores are recomputed
exactly, in double precision, on the original vectors.

Edge cases: vectors and queries that are null, empty, zero, of another length than the commonest vectors', or hold null or
non-finite components take no part; so do rows with a null id; repeated ids are rows of their own and no candidate of
each other; with fewer than k candidates all are returned; elements that aren't floats are taken as doubles; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from gleaner.llm.common import small, written


#: Queries whose products with a bucket are held at once, and pairs that are scored exactly at once.
QUERIES, PAIRS = 256, 200_000
#: Rows of buckets that are sent to every executor.
SMALL_BUCKETS = 200_000


@dataclass(frozen=True)
class Params:
    k: int = 20
    recall: float = 0.96
    #: The recall that queries must have which didn't choose the visits.
    least: float = 0.93
    #: Vectors that the tree is fitted on.
    sample: int = 65_536
    #: Queries that calibrate the number of visits, and as many that check it.
    calibrate: int = 200
    branching: int = 12
    #: Vectors a leaf should hold, from which the tree's size follows, up to what the sample can tell apart.
    leaf: int = 256
    most_leaves: int = 8192
    #: Vectors in a bucket at most, about: neighbouring leaves are scored together, larger leaves are split.
    bucket: int = 4096
    #: Queries that are scored in one group, about.
    together: int = 20_000
    rounds: int = 8
    seed: int = 5


class Tree:
    """Nodes in one array of centres; children of node i are ``first[i]`` to ``first[i] + n[i]``; leaves have none."""

    def __init__(self, centres: np.ndarray, first: np.ndarray, n: np.ndarray):
        self.centres, self.first, self.n = centres, first, n
        self.norms = (centres**2).sum(1)
        self.leaves = int((n == 0).sum())

    @classmethod
    def fit(cls, x: np.ndarray, leaves: int, p: Params) -> Tree:
        rng = np.random.default_rng(p.seed)
        centres, first, n = [x.mean(0)], [0], [0]
        # The largest leaf is split until there are enough, so depth follows density.
        heap = [(-len(x), 0, np.arange(len(x)))]
        count = 1
        while heap and count < leaves:
            size, node, own = heapq.heappop(heap)
            if -size < 2 * p.branching:
                break
            label, own_centres = _kmeans(x[own], min(p.branching, leaves - count + 1), rng, p.rounds)
            if len(own_centres) < 2:
                continue
            first[node], n[node] = len(centres), len(own_centres)
            for c in range(len(own_centres)):
                members = own[label == c]
                heapq.heappush(heap, (-len(members), len(centres), members))
                centres.append(own_centres[c])
                first.append(0)
                n.append(0)
            count += len(own_centres) - 1
        return cls(np.array(centres, np.float64), np.array(first), np.array(n))

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child, level by level."""
        at = np.zeros(len(x), np.int64)
        while True:
            moved = False
            for node in np.unique(at[self.n[at] > 0]):
                own = np.flatnonzero(at == node)
                kids = slice(self.first[node], self.first[node] + self.n[node])
                at[own] = self.first[node] + np.argmin(self.norms[kids] - 2 * x[own] @ self.centres[kids].T, axis=1)
                moved = True
            if not moved:
                return at

    def walk(self, q: np.ndarray, visits: int, sizes: dict[int, int] | None = None, enough: int = 0) -> list[int]:
        """The first ``visits`` leaves, best bin first, and more until they hold ``enough`` vectors."""
        far = self.norms - 2 * (self.centres @ q)
        queue, out, held = [(far[0], 0)], [], 0
        while queue and (len(out) < visits or held < enough):
            _, node = heapq.heappop(queue)
            if self.n[node] == 0:
                out.append(node)
                held += sizes.get(node, 0) if sizes else 0
            for kid in range(self.first[node], self.first[node] + self.n[node]):
                heapq.heappush(queue, (far[kid], kid))
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        label = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        size = np.bincount(label, minlength=len(centres))
        summed = np.zeros_like(centres)
        np.add.at(summed, label, x)
        centres = summed[size > 0] / size[size > 0, None]
    return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1), centres


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.empty((0, 0))


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(0.0, most - (x**2).sum(1)))[:, None]], axis=1)


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def exact_best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, rough: np.ndarray | None = None) -> pd.DataFrame:
    """The best k vectors of each query, scored exactly; ties to the smaller id.

    ``rough`` holds approximate products, minus infinity for vectors that aren't searched; it is made if not given.
    All vectors within rounding of the k-th product are scored anew, so that equal vectors tie exactly.
    """
    rough = q @ x.T if rough is None else rough
    rough[q_ids[:, None] == ids[None, :]] = -np.inf
    slack = 1e-9 * (1 + np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1])
    cut = np.partition(rough, -k, axis=1)[:, -k] - slack if rough.shape[1] > k else np.full(len(q), -np.inf)
    row, col = np.nonzero((rough >= cut[:, None]) & (rough > -np.inf))
    score = np.empty(len(row))
    for a in range(0, len(row), PAIRS):
        score[a : a + PAIRS] = (x[col[a : a + PAIRS]] * q[row[a : a + PAIRS]]).sum(axis=1)
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    first = np.searchsorted(row, np.arange(len(q)))
    best = np.arange(len(row)) - first[row] < k
    return pd.DataFrame({"query_id": q_ids[row[best]], "vec_id": ids[col[best]], "score": score[best]})


_BEST = "query_id long, vec_id long, score double"


def _merge(best: DataFrame, k: int) -> DataFrame:
    """The best k of each query's candidates; each task keeps k of a query before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scan(queries, k: int):
    """Answers a bounded set of queries against a stream of vectors, keeping the best k."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q = queries.value
        best = None
        for pdf in batches:
            for a in range(0, len(pdf), 4096):
                part = pdf.iloc[a : a + 4096]
                own = exact_best(q_ids, q, part["vec_id"].to_numpy(np.int64), _matrix(part["embedding"]), k)
                best = pd.concat([best, own]).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)
        if best is not None:
            yield best

    return run


def _file(tree, most: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = tree.value
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(leaf=own.file(_lifted(_matrix(pdf["embedding"]), most)).astype(np.int32))

    return run


def _visits(tree, buckets: dict[int, tuple[int, int]], visits: int, sizes: dict[int, int], enough: int):
    """A row for each query and bucket, with the leaves of the bucket that the query visits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = tree.value
        for pdf in batches:
            rows = []
            for i, v in zip(pdf["vec_id"], pdf["embedding"], strict=True):
                by_bucket: dict[int, list[int]] = {}
                for leaf in own.walk(np.append(np.asarray(v, np.float64), 0.0), visits, sizes, enough):
                    first, n = buckets.get(leaf, (0, 0))
                    for bucket in range(first, first + n):
                        by_bucket.setdefault(bucket, []).append(leaf)
                rows += [(bucket, i, v, leaves) for bucket, leaves in by_bucket.items()]
            yield pd.DataFrame(rows, columns=["bucket", "query_id", "query", "leaves"])

    return run


def _score(k: int):
    def run(key, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        vectors = vectors.sort_values("leaf", kind="stable")
        x, ids, leaf = _matrix(vectors["embedding"]), vectors["vec_id"].to_numpy(np.int64), vectors["leaf"].to_numpy()
        out = []
        for a in range(0, len(queries) if len(x) else 0, QUERIES):
            part = queries.iloc[a : a + QUERIES]
            q = _matrix(part["query"])
            asked = np.concatenate([np.asarray(v) for v in part["leaves"]])
            asker = np.repeat(np.arange(len(part)), part["leaves"].map(len))
            rough = np.full((len(q), len(x)), -np.inf)
            for own in np.unique(asked):
                who = asker[asked == own]
                span = slice(*np.searchsorted(leaf, [own, own + 1]))
                rough[who, span] = q[who] @ x[span].T
            out.append(exact_best(part["query_id"].to_numpy(np.int64), q, ids, x, k, rough))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})

    return run


def _numbers(df: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that may take part; elements stay floats or become doubles."""
    kind = df.schema["embedding"].dataType
    own = F.col("embedding") if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else F.col("embedding").cast("array<double>")
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), own.alias("embedding")).filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())


def _kind(df: DataFrame) -> str:
    return df.schema["embedding"].dataType.simpleString()


class Index:
    """A fitted tree, the filed vectors and the calibrated number of leaf visits; ``recall`` is that of the queries that
    didn't choose it."""

    def __init__(self, vectors: DataFrame, p: Params = Params()):
        spark = vectors.sparkSession
        self.p = p
        good = _numbers(vectors)
        size = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").head()
        self.empty = size is None
        if self.empty:
            self.files = good
            return
        self.length = size["d"]
        good = good.filter(F.size("embedding") == self.length)
        n = size["count"]
        squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        self.most = good.agg(F.max(squares)).head()[0]
        sample = good.orderBy(F.xxhash64(F.lit(p.seed), "vec_id"), "vec_id").limit(p.sample).toPandas()
        x = _matrix(sample["embedding"])
        leaves = int(min(p.most_leaves, max(1, n // p.leaf), max(1, len(x) // 8)))
        tree = Tree.fit(_lifted(x, self.most), leaves, p)
        self.tree = spark.sparkContext.broadcast(tree)
        filed = written(good.mapInPandas(_file(self.tree, self.most), f"vec_id long, embedding {_kind(good)}, leaf int"), "filed")
        #: Vectors of one id at most: a query's own are no candidates.
        self.same = filed.groupBy("vec_id").count().agg(F.max("count")).head()[0]
        self.sizes = sizes = {r.leaf: r["count"] for r in filed.groupBy("leaf").count().collect()}  # a row per leaf
        #: The first bucket of each leaf, and over how many its vectors are spread.
        self.buckets: dict[int, tuple[int, int]] = {}
        bucket, held = 0, 0
        for leaf, c in sorted(sizes.items()):
            if held and held + c > p.bucket:
                bucket, held = bucket + 1, 0
            n = max(1, -(-c // p.bucket))
            self.buckets[leaf] = (bucket, n)
            bucket, held = (bucket + n, 0) if n > 1 else (bucket, held + c)
        places = vectors.sparkSession.createDataFrame([(leaf, *x) for leaf, x in self.buckets.items()], "leaf int, first int, many int")
        placed = filed.join(F.broadcast(places), "leaf")
        self.files = placed.withColumn("bucket", (F.col("first") + F.pmod(F.xxhash64(F.lit(p.seed), "vec_id"), "many")).cast("int")).drop("first", "many")
        self.calibrate()

    def calibrate(self) -> None:
        """Widens the visits until the exact best of the calibrating queries are found often enough, and of the checking ones too."""
        p, spark = self.p, self.files.sparkSession
        own = self.files.orderBy(F.xxhash64(F.lit(p.seed + 1), "vec_id"), "vec_id").limit(2 * p.calibrate).select("vec_id", "embedding").toPandas()
        queries = spark.sparkContext.broadcast((own["vec_id"].to_numpy(np.int64), _matrix(own["embedding"])))
        best = _merge(self.files.select("vec_id", "embedding").mapInPandas(_scan(queries, p.k), _BEST), p.k)
        # The leaves of the exact best, a row for each of at most 2 * calibrate * k.
        found = self.files.select("vec_id", "leaf").join(F.broadcast(best.select("query_id", "vec_id")), "vec_id").select("query_id", "leaf").toPandas()
        tree, ranks = self.tree.value, []
        for i, q in zip(own["vec_id"], _matrix(own["embedding"]), strict=True):
            order = {leaf: r for r, leaf in enumerate(tree.walk(np.append(q, 0.0), tree.leaves))}
            ranks.append([order[x] for x in found.loc[found["query_id"] == i, "leaf"]])
        chosen, checked = (np.array([r for x in half for r in x]) for half in (ranks[::2], ranks[1::2]))

        def recall(of: np.ndarray) -> float:
            return float((of < self.visits).mean()) if len(of) else 1.0

        self.visits = 1
        while self.visits < tree.leaves and (recall(chosen) < p.recall or recall(checked) < p.least):
            self.visits += max(1, self.visits // 16)
        self.visits = min(self.visits, tree.leaves)
        self.calibrated, self.recall = recall(chosen), recall(checked)

    def search(self, queries: DataFrame) -> DataFrame:
        """query_id, rank, vec_id and score of the best k of every query (vec_id, embedding)."""
        if self.empty:
            return self.files.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
        queries = _numbers(queries).filter(F.size("embedding") == self.length)
        visits = _visits(self.tree, self.buckets, self.visits, self.sizes, self.p.k + self.same)
        asked = queries.mapInPandas(visits, f"bucket int, query_id long, query {_kind(queries)}, leaves array<int>")
        asked = written(asked, "visits")
        # A bucket's queries are spread over parts by their number, so a group is a bucket's bounded vectors with a bounded
        # share of the queries that visit it; vectors are copied in proportion to the visits.
        busy = asked.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / self.p.together).cast("int").alias("parts"))
        busy = small(written(busy, "busy-buckets"), SMALL_BUCKETS)
        asked = asked.join(busy, "bucket").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).drop("parts")
        copies = self.files.join(busy, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "leaf", "vec_id", "embedding")
        pairs = copies.groupBy("bucket", "part").cogroup(asked.groupBy("bucket", "part"))
        return _merge(pairs.applyInPandas(_score(self.p.k), _BEST), self.p.k)


def search(vectors: DataFrame, queries: DataFrame, p: Params = Params()) -> DataFrame:
    return Index(vectors, p).search(queries)
