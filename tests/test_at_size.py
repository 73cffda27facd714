"""What larger tables brought up: results of rows that the smallest tables lack, and shapes of plans that have to stay bounded."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from gleaner.plans import catalog, feeds  # noqa: F401


def test_navigation_chunks_takes_the_words_of_its_sql(spark, tmp_path):
    import duckdb

    body = "Las esosra las ue, cionga ueosco ciones cion osco las en.\n"
    texts = [body + word for word in ("All rights reserved.", "Menu, search and share it.", "Newsletter and advertisement", "Home, about us, contact", "and nothing else in it")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(catalog.ORACLE_SQL["navigation_chunks"]).fetchall())
    assert sorted(tuple(r) for r in catalog.QUERIES["navigation_chunks"](spark, str(tmp_path)).collect()) == want
    assert [n for _, n in want] == [False, True, False, True, False]


def test_the_driver_gets_the_fitted_model_and_no_features(spark, monkeypatch):
    from gleaner.llm import quality

    words = ["good stone garden", "bad junk spam"]
    docs = spark.createDataFrame([(i, f"{words[i % 2]} number {i}") for i in range(40)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(1 - doc_id % 2 as int) AS quality")
    got, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: got.append(self.columns) or collect(self))
    p = quality.Params(buckets=1024, epochs=20)
    model = quality.train(docs, labels, p)
    assert got == [["logits", "bias"]]
    good, bad = quality.scores(model, words, p)
    assert good > 0.5 > bad


def test_anchor_pairs_in_cells_lose_and_repeat_none(spark):
    """Several anchors a cluster, repeated ids, groups of many parts; no step tells all pairs apart."""
    from gleaner.operators import joins

    rng = random.Random(5)
    rows = [(rng.randrange(150), rng.choice(["p", "q", None]), rng.randrange(12), [rng.choice("abcd") for _ in range(rng.randrange(4))] + [None] * (k % 3 == 0)) for k in range(200)]
    rows += [(i, p, n, None) for i, p, n, _ in rows[:5]]
    c = spark.createDataFrame(rows, "cluster_id long, poi_name string, size int, anchors array<string>")
    want = {(a, b) for a, p, n, s in rows for b, q, m, t in rows if p and p == q and a < b and abs(n - m) < 3 and set(s or []) & set(t or []) - {None}}
    for part in (7, 2000):
        got = [tuple(r) for r in joins.anchor_pairs(c, F.abs(F.col("x.size") - F.col("y.size")), 3, part).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    alone = spark.createDataFrame([(k, "p", 1, ["a"]) for k in range(300)], c.schema)
    found = joins.anchor_pairs(alone, F.lit(0), 1, 10)
    found.collect()
    assert "keys=[a" not in found._jdf.queryExecution().executedPlan().toString().split("Final Plan")[-1].split("Initial Plan")[0]


def test_embedded_documents_holds_bounded_batches(spark, tmp_path, monkeypatch):
    import numpy as np

    from gleaner import models

    class Sizes:
        def embed(self, texts):
            return np.full((len(texts), 1), len(texts))

    embed = models.embed_column
    monkeypatch.setattr(models, "embed_column", lambda embedder: embed(Sizes(), 10**9))
    spark.range(5000).selectExpr("id AS doc_id", "cast(id AS string) AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.unset(key)
    got = catalog.QUERIES["embedded_documents"](spark, str(tmp_path)).collect()
    assert len(got) == 5000 and max(r.embedding[0] for r in got) <= 1000


def test_extracted_insights_holds_bounded_batches(spark):
    from gleaner import models

    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.unset(key)
    got = models.map_batches(spark.range(5000).coalesce(1), lambda rows: [{"n": len(rows)}], "n long", 10**9).collect()
    assert sum(r.n for r in got) == 5000 and max(r.n for r in got) <= 1000


def test_navigation_cleans_a_chunk_once(spark):
    """Inside lambdas every mention of a chunk's cleaned text cleaned it again: 24 times."""
    from gleaner.operators import cleaning

    df = spark.createDataFrame([("x",)], "t string").select(cleaning.is_navigation(F.col("t")).alias("n"))
    assert df._jdf.queryExecution().analyzed().toString().lower().count("regexp_replace(") == 1


def test_linkage_meets_a_bounded_number_of_blocks(spark, monkeypatch):
    import numpy as np

    from gleaner.operators import linkage, vectors

    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(30, 6)), 8, axis=0) + rng.normal(size=(240, 6)) * 0.25
    df = spark.createDataFrame([("p", k, [float(v) for v in row]) for k, row in enumerate(x)], "place string, idx long, v array<double>")
    sizes = spark.createDataFrame([("p", 240)], "place string, n_alive long")
    alive = df.select("place", F.col("idx").alias("cluster"), F.col("v").alias("mean"))
    assert {r.n_blocks for r in linkage._blocks(alive, sizes, 4, "q").collect()} == {16}
    monkeypatch.setattr(linkage, "CELL", 50)
    got: dict = {}
    for r in linkage.link(df, "place", "idx", "v", 0.28, 150, 4).collect():
        got.setdefault(r.cluster, []).append(r.idx)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, vectors.average_linkage(x, 0.28)))


def test_name_mentions_asks_for_bounded_batches(spark):
    from gleaner.operators import mentions

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(key)
    df = spark.createDataFrame([(1, "old bridge")], "id long, text string")
    assert [tuple(r) for r in mentions.count_mentions(df, "id", "text", df.select(F.col("text").alias("name"))).collect()] == [(1, "old bridge", 1)]
    assert spark.conf.get(key) == "1000"
