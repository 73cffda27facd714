"""Many searches at once against one search at a time."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions.taxonomy import VALID_L1
from gleaner.operators import search
from gleaner.plans.engine import Engine, Store


@pytest.fixture(scope="module")
def engine(spark):
    rng = np.random.default_rng(2)
    made = []
    for k in range(240):
        v = [float(x) for x in np.round(rng.normal(size=6), 1)] if k % 50 else [0.0] * 6
        made.append((k, f"p{k % 3}", f"cluster {k}", VALID_L1[k % 5], VALID_L1[(k * 3 + 1) % 5], ["positive", "negative", "mixed", None][k % 4], "ABC"[k % 3] if k % 11 else None, k % 40, k % 6 + 1, [f"anchor{k % 7}"], v, [k * 2], [k, k + 1]))
    schema = "cluster_id long, poi_name string, name string, l1 string, secondary_l1 string, sentiment string, quality_tier string, size int, n_sources int, anchor_entities array<string>, embedding array<double>, centroid_text_indices array<long>, member_indices array<long>"
    clusters = spark.createDataFrame(made, schema).withColumns({"l2": F.lit("topic"), "l3": F.lit("detail")}).repartition(5)
    insights = spark.range(0, 500).select(F.col("id").alias("flat_idx"), F.lit("s").alias("source"), F.col("id").cast("string").alias("source_id"), F.lit("a").alias("anchor_entity"))
    raw = insights.select("source", "source_id", F.concat(F.lit("raw text "), "source_id").alias("text"), F.lit(3).alias("rating"), F.lit("u").alias("source_url"))
    return Engine(Store(clusters, insights, raw))


QUERIES = [
    {"poi": "p0", "query": "the best of anchor3", "vector": [1.0, 0, 0, 0.5, 0, 0]},
    {"poi": "p1", "query": "avoid", "vector": [0.0, 1, 0, 0, 0, -1], "min_tier": "C"},
    {"poi": "p1", "query": "anything", "vector": [0.0, 0, 1, 0, 1, 0], "l1": VALID_L1[2], "min_tier": "C"},
    {"poi": "p2", "query": "zero", "vector": [0.0] * 6, "min_tier": "C"},
    {"poi": "nowhere", "query": "anchor1", "vector": [1.0] * 6},
]


@pytest.mark.parametrize("block", [1024, 2])
def test_many_searches_are_single_ones(engine, monkeypatch, block):
    monkeypatch.setattr(search, "QUERY_BLOCK", block)
    got = {}
    for r in engine.ranked_many(QUERIES).collect():
        got.setdefault(r.query_no, set()).add((r.cluster_id, round(r.cosine, 8), round(r.score, 8)))
    for k, q in enumerate(QUERIES):
        want = engine.ranked_clusters(q["poi"], q["query"], q["vector"], q.get("l1"), q.get("min_tier", "B")).collect()
        assert got.get(k, set()) == {(r.cluster_id, round(r.cosine, 8), round(r.score, 8)) for r in want}


def test_sweep_keeps_the_first_hit(engine):
    asked = [(q["query"], q["vector"]) for q in QUERIES[:4]]
    want = {}
    for k, (q, v) in enumerate(asked):
        for r in engine.ranked_clusters("p1", q, v).orderBy(F.desc("score"), "cluster_id").limit(5).collect():
            want.setdefault(r.cluster_id, k)
    assert {r.cluster_id: r.query_no for r in engine.sweep("p1", asked).collect()} == want


def test_evaluation_is_that_of_single_searches(engine):
    golden = [{**q, "expected_l1": e, "must_mention": m} for q, e, m in zip(QUERIES, [VALID_L1[0], VALID_L1[1], None, VALID_L1[4], None], [["CLUSTER 3"], [], ["raw text 4", "nothing"], ["none of it"], []], strict=True)]
    got = {r.query_no: r for r in engine.evaluate(golden).collect()}
    assert len(got) == 5
    for k, g in enumerate(golden):
        hits = engine.search_clusters(g["poi"], g["query"], g["vector"], g.get("l1"), min_tier=g.get("min_tier", "B")).collect()
        quotes = [x.raw_text for h in hits[:3] for x in engine.explain_cluster(h.cluster_id, 3).collect()]
        said = " ".join([h.name for h in hits] + quotes).lower()
        terms = [t for t in g["must_mention"] if t.lower() in said]
        passed = (not g["expected_l1"] or any(h.l1 == g["expected_l1"] for h in hits[:3])) and (not g["must_mention"] or bool(terms))
        assert (got[k].passed, sorted(got[k].matched_terms), got[k].n_hits) == (passed, sorted(terms), len(hits))


def test_no_queries_and_empty_store(engine, spark):
    assert engine.ranked_many([]).collect() == []
    empty = Engine(Store(engine.store.clusters.limit(0), engine.store.insights, engine.store.raw))
    assert empty.ranked_many(QUERIES).collect() == []
    assert [r.passed for r in empty.evaluate([{**QUERIES[0], "expected_l1": None, "must_mention": []}]).collect()] == [True]
