"""Columns of clashing and dotted names, repeated rows and clashing digests; the pipeline's edge cases."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, jaccard, mixing

TEXT = " ".join(f"word{k}" for k in range(60))
NAMES = ["_row", "_c", "_k", "_bad_row", "_place", "_mix_id", "_mix_tie", "_mix_source", "shard", "mix_shard", "_mix_shard", "copy", "node", "d1", "a.b", "a`b", "rank"]


def clashing(spark, rows):
    """doc_id, text and source with columns that the operators name inside, and names that must be quoted."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    return df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(NAMES)])


def extras(row):
    return [row[n] for n in NAMES] == list(range(len(NAMES)))


@pytest.fixture
def rows(spark):
    made = [(k, f"{TEXT} end{k}" if k < 3 else f"own{k} text of few words", "s", "en", 1) for k in range(8)]
    return clashing(spark, [*made, made[0], made[7], made[7], (None, TEXT, None, None, None), (20, None, "s", "en", 0), (21, "", "t", "en", 0)])


def test_keep_one_keeps_columns_of_any_name(rows):
    got = jaccard.keep_one(rows, jaccard.Similarity(5, 80)).collect()
    assert all(map(extras, got))
    assert sorted((r.doc_id for r in got), key=str) == [0, 20, 21, 3, 4, 5, 6, 7, None]


def test_clean_keeps_columns_of_any_name(spark, rows):
    bench = spark.createDataFrame([("q", " ".join(f"word{k}" for k in range(20, 40)))], "item_id string, text string")
    got = decontaminate.clean(rows, bench).collect()
    assert all(map(extras, got)) and len(got) == rows.count() - 5


def test_mix_keeps_columns_of_any_name(rows):
    got = mixing.mix(rows).collect()
    assert got and all(map(extras, got)) and set(rows.columns) < set(got[0].asDict())


def test_repeated_rows_are_one_class(spark):
    texts = [TEXT, TEXT.replace("word30", "other"), "another text that has its own words here"]
    many = spark.createDataFrame([(k % 3, texts[k % 3]) for k in range(1500)], "doc_id long, text string").repartition(6)
    found = jaccard._Classes(jaccard._rows(many), jaccard.Similarity(5, 80))
    assert found.chosen.count() == 3
    pairs, members = jaccard.join(many, jaccard.Similarity(5, 80))
    assert [tuple(r) for r in pairs.collect()] == [(0, 1)]
    assert members.groupBy("doc_id").count().filter("count = 500").count() == 3


def test_classes_are_told_apart_by_the_whole_digest(spark, monkeypatch):
    """Half of the digest takes five values: unlike documents still stay apart."""
    whole = jaccard._digest

    def short(own, doc_id):
        high, low = whole(own, doc_id)
        return high % 5, low

    monkeypatch.setattr(jaccard, "_digest", short)
    rows = [(k, f"{TEXT} end{k}") for k in range(3)] + [(k, " ".join(f"w{k}x{j}" for j in range(12))) for k in range(10, 22)]
    got = {r.doc_id: r.component_id for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string"), jaccard.Similarity(5, 80)).collect()}
    assert got == {0: 0, 1: 0, 2: 0} | {k: k for k in range(10, 22)}


def test_pipeline_run_with_edge_cases(spark, tmp_path):
    long = " ".join(f"term{k}" for k in range(3000))
    rows = [(k, f"{TEXT} number {k} " + " ".join(f"u{k}v{j}" for j in range(40)), f"s{k % 2}", "en", 1) for k in range(40)]
    rows += [rows[3], rows[3], (None, "a text without an id", "s0", "en", 1), (50, None, None, None, None), (51, "", "s1", "en", 0), (52, long, "s1", "en", 1)]
    clashing(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("q", "a passage of the benchmark that nobody has copied into any of the texts here")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {*range(40), None, 50, 51, 52} and all(r.n_tokens >= 1 for r in got)
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert [s for s, _ in starts] == [sum(n for _, n in starts[:k]) for k in range(len(starts))]


def test_pipeline_run_of_empty_tables(spark, tmp_path):
    clashing(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
