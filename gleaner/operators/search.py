"""Many searches in one pass: blocks of query vectors against batches of stored vectors, with partial top-k in each task.

Queries are a list of the caller's (name, place, vector and conditions), so they are a bounded broadcast; the store is scanned once
for each ``QUERY_BLOCK`` of them.  A task keeps the best ``k`` rows of each query, so what is shuffled is k rows a query and
task, whatever the store holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.sampling import top_per_group
from gleaner.operators.vectors import EPSILON

#: Queries of a pass, and digits that a cosine is compared by.
QUERY_BLOCK, DIGITS = 1024, 9


@dataclass(frozen=True)
class Query:
    """A search of a place: rows of ``label`` (first or second, if there is one) whose tier is ``max_tier`` at most (0 the best)."""

    no: int
    place: str
    vector: list[float]
    max_tier: int = 99
    label: str | None = None


class _Best:
    """The best k rows of a query so far: highest cosine first, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.cosine, self.ids = k, np.empty(0), np.empty(0, np.int64)

    def add(self, cosine: np.ndarray, ids: np.ndarray) -> None:
        if len(ids) > 4 * self.k:  # the k-th highest cosine, with all its ties
            least = np.partition(cosine, -self.k)[-self.k]
            cosine, ids = cosine[cosine >= least], ids[cosine >= least]
        cosine, ids = np.concatenate([self.cosine, cosine]), np.concatenate([self.ids, ids])
        first = np.lexsort((ids, -cosine))[: self.k]
        self.cosine, self.ids = cosine[first], ids[first]


def _matrix(vectors: pa.Array) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors.to_numpy(zero_copy_only=False)])


def _scan(queries: list[Query], k: int):
    shape = pa.schema([("query_no", pa.int32()), ("id", pa.int64()), ("cosine", pa.float64())])
    by_place: dict[str, list[int]] = {}
    for i, q in enumerate(queries):
        by_place.setdefault(q.place, []).append(i)
    unit = np.array([q.vector for q in queries], np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True) + EPSILON

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k) for _ in queries]
        for b in batches:
            places = np.array(b["place"].to_pylist(), object)
            ids, tiers = b["id"].to_numpy(), b["tier"].to_numpy()
            labels = [np.array(b[c].to_pylist(), object) for c in ("label", "second")]
            for place, own in by_place.items():
                rows = np.flatnonzero(places == place)
                if not len(rows):
                    continue
                x = _matrix(b["vector"].take(pa.array(rows)))
                cosine = np.round(unit[own] @ (x / (np.linalg.norm(x, axis=1, keepdims=True) + EPSILON)).T, DIGITS)
                for at, i in enumerate(own):
                    fits = tiers[rows] <= queries[i].max_tier
                    if queries[i].label is not None:
                        fits &= (labels[0][rows] == queries[i].label) | (labels[1][rows] == queries[i].label)
                    best[i].add(cosine[at][fits], ids[rows][fits])
        for q, own in zip(queries, best, strict=True):
            if len(own.ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own.ids), q.no, np.int32)), pa.array(own.ids), pa.array(own.cosine)], schema=shape)

    return run


def nearest(rows: DataFrame, queries: list[Query], k: int, key: str, vector: str, place: str, tier: Column, labels: tuple[Column, Column]) -> DataFrame:
    """query_no, ``key`` and cosine of the k nearest rows of each query that meet its conditions, ties to the smaller key.

    ``rows`` with a null vector, key or tier take no part.  ``tier`` is a number, ``labels`` are the first and the second label."""
    own = rows.select(F.col(key).cast("long").alias("id"), F.col(place).alias("place"), tier.cast("int").alias("tier"), labels[0].alias("label"), labels[1].alias("second"), F.col(vector).alias("vector"))
    own = own.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & F.col("tier").isNotNull() & F.col("place").isin(sorted({q.place for q in queries})))
    found = None
    for at in range(0, len(queries), QUERY_BLOCK):
        part = own.mapInArrow(_scan(queries[at : at + QUERY_BLOCK], k), "query_no int, id long, cosine double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "query_no int, id long, cosine double")
    return top_per_group(found, ["query_no"], [F.desc("cosine"), F.asc("id")], k, "_rank").drop("_rank").withColumnRenamed("id", key)
