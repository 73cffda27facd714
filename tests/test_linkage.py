"""Linkage over many tasks against the one-task algorithm, with ties, small and large places, and anchors."""

from __future__ import annotations

import numpy as np

from gleaner.operators import linkage, vectors

SCHEMA = "poi_name string, flat_idx long, embedding array<double>, anchor_entity string"
GROUPS = 12


def place_rows(rng, name, n, first, dim=16):
    centres = rng.normal(size=(GROUPS, dim))
    which = rng.integers(GROUPS, size=n)
    x = centres[which] + rng.normal(size=(n, dim)) * 0.55
    x[: n // 10] = x[0]  # equal vectors
    anchors = [["Louvre", None, "", f" Anchor{w % 3} ", f"anchor{w}"][int(rng.integers(5))] for w in which]
    return [(name, first + i, [float(z) for z in v], a) for i, (v, a) in enumerate(zip(x, anchors, strict=True))]


def clusters_of(df):
    return {(r.poi_name, frozenset(r.member_indices)) for r in df.collect()}


def test_many_tasks_find_the_same_clusters(spark):
    rng = np.random.default_rng(5)
    rows = place_rows(rng, "large", 260, 0) + place_rows(rng, "small", 60, 1000) + [("one", 5000, [1.0] * 16, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for merge in (True,):
        want = vectors.cluster_places(df, merge=merge)
        got = vectors.cluster_places(df, merge=merge, most=120)
        assert got.columns == want.columns
        assert clusters_of(got) == clusters_of(want)
    sizes = [(r.n_in_place, r["size"]) for r in got.filter("poi_name = 'large'").orderBy("n_in_place").collect()]
    assert [k for k, _ in sizes] == list(range(len(sizes))) and [n for _, n in sizes] == sorted((n for _, n in sizes), reverse=True)


def test_equal_and_far_vectors(spark):
    axes = np.eye(8)
    rows = [("p", k, axes[k % 8].tolist(), None) for k in range(40)]  # eight clusters of equal vectors, none near another
    got = linkage.link(spark.createDataFrame(rows, SCHEMA), "poi_name", "flat_idx", "embedding", 0.28, 2).collect()
    assert {(r.flat_idx, r.cluster) for r in got} == {(k, k % 8) for k in range(40)}
    assert linkage.link(spark.createDataFrame([], SCHEMA), "poi_name", "flat_idx", "embedding", 0.28, 2).collect() == []
