"""The jobs: growing input, repeated runs, failures between writes, edge cases, and their queries against SQL."""

from __future__ import annotations

import json
import os
import subprocess
import sys

import pytest

from jobs import dossiers, intake, queries
from jobs.common import settings_of

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LONG = "A sentence of several words stands here. " * 10


def put(spark, folder, rows, name):
    df = spark.createDataFrame(rows, intake.DOCUMENTS)
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def ledger(spark, settings):
    return sorted((tuple(r) for r in intake.ledger(spark, settings.output).collect()), key=str)


def settings_in(tmp_path, **more):
    return intake.Settings(f"{tmp_path}/in/*", f"{tmp_path}/out", f"{tmp_path}/checkpoint", **more)


def decisions_of(spark, settings):
    return {(r["batch"], r["doc_id"], r["decision"]) for r in intake.decisions(spark, settings.output).collect()}


def test_intake_takes_only_what_is_new(spark, tmp_path):
    settings = settings_in(tmp_path)
    put(spark, f"{tmp_path}/in", [(1, LONG + "Great love it is.", "en", "a"), (2, LONG + "Avoid the bad queue of 3 hours.", "", "b"), (3, "short", "en", "a")], "first")
    intake.run(spark, settings)
    first = ledger(spark, settings)
    assert decisions_of(spark, settings) == {(0, 1, "kept"), (0, 2, "kept"), (0, 3, "too_short_<250")}
    # The same text again, under another id; a new text; an id of an earlier one with another text.
    put(spark, f"{tmp_path}/in", [(4, LONG + "Great love it is.", "en", "c"), (5, LONG + "You should go there soon.", "fr", None), (2, LONG + "Changed since then.", "en", "b")], "second")
    intake.run(spark, settings)
    second = ledger(spark, settings)
    assert set(first) <= set(second)
    assert decisions_of(spark, settings) - {(0, 1, "kept"), (0, 2, "kept"), (0, 3, "too_short_<250")} == {(1, 4, "repeated"), (1, 5, "kept"), (1, 2, "kept")}
    intake.run(spark, settings)  # nothing new
    assert ledger(spark, settings) == second
    report = {(r["source"], r["decision"]): r["n_documents"] for r in spark.read.parquet(f"{settings.output}/report").collect()}
    assert report == {("a", "kept"): 1, ("b", "kept"): 2, ("a", "too_short_<250"): 1, ("c", "repeated"): 1, (None, "kept"): 1}
    tags = {(r["doc_id"], r["sentiment"], r["intent"], r["source_name"]) for r in intake.insights(spark, settings.output).filter("doc_id IN (1, 2, 5) AND (sentiment <> 'neutral' OR intent <> 'description')").collect()}
    assert tags == {(1, "positive", "description", "a"), (2, "negative", "warning", "b"), (5, "neutral", "recommendation", "unknown")}


def test_intake_in_small_batches_agrees(spark, tmp_path):
    for k in range(3):
        put(spark, f"{tmp_path}/in", [(10 * k + j, LONG + f"Number {(10 * k + j) % 7} ends it.", "en", f"s{j % 2}") for j in range(5)], f"f{k}")
    one, many = settings_in(tmp_path), intake.Settings(f"{tmp_path}/in/*", f"{tmp_path}/out2", f"{tmp_path}/checkpoint2", files_per_batch=1)
    intake.run(spark, one)
    intake.run(spark, many)
    kept = lambda s: sorted(r["text"] for r in intake.decisions(spark, s.output).filter("decision = 'kept'").collect())
    assert kept(one) == kept(many)
    assert len({b for b, _, _ in decisions_of(spark, many)}) > 1


def test_intake_survives_a_failure_between_writes(spark, tmp_path, monkeypatch):
    settings = settings_in(tmp_path)
    put(spark, f"{tmp_path}/in", [(1, LONG, "en", "a"), (2, LONG, "en", "a")], "first")
    monkeypatch.setattr(intake, "insights_of", lambda *a: 1 / 0)
    with pytest.raises(Exception, match="(?i)division|exception"):
        intake.run(spark, settings)
    monkeypatch.undo()
    intake.run(spark, settings)  # the same batch again
    assert decisions_of(spark, settings) == {(0, 1, "kept"), (0, 2, "repeated")}
    assert intake.insights(spark, settings.output).filter("doc_id = 1").count() == 10


def test_intake_edges(spark, tmp_path):
    settings = settings_in(tmp_path)
    put(spark, f"{tmp_path}/in", [(None, LONG, "en", "a"), (1, None, None, None), (2, "", "en", ""), (3, " \n\t", "en", "a"), (4, LONG, None, ""), (4, LONG, None, ""), (5, "word " * 60_000 + ".", "en", "a")], "first")
    intake.run(spark, settings)
    assert decisions_of(spark, settings) == {(0, None, "no_id"), (0, 1, "empty_text"), (0, 2, "empty_text"), (0, 3, "empty_text"), (0, 4, "kept"), (0, 5, "kept")}
    rows = {r["doc_id"]: r for r in intake.ledger(spark, settings.output).filter("doc_id IN (4, 5)").collect()}
    assert rows[4]["language"] == "en" and rows[4]["n_insights"] == 10 and rows[5]["n_insights"] == 1
    empty = intake.Settings(f"{tmp_path}/none", f"{tmp_path}/out3", f"{tmp_path}/c3")
    spark.createDataFrame([], intake.DOCUMENTS).write.parquet(empty.input)
    intake.run(spark, empty)
    assert ledger(spark, empty) == [] and spark.read.parquet(f"{empty.output}/report").count() == 0


def test_intake_command_line(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [(1, LONG, "en", "a")], "first")
    with open(f"{tmp_path}/own.json", "w") as f:
        json.dump({"input": f"{tmp_path}/in/*", "output": "set by the option", "checkpoint": f"{tmp_path}/c"}, f)
    env = os.environ | {"PYTHONPATH": ROOT, "SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run([sys.executable, f"{ROOT}/jobs/intake.py", "--config", f"{tmp_path}/own.json", "--output", f"{tmp_path}/out"], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 1 documents" in done.stderr and "kept 1" in done.stderr
    assert intake.decisions(spark, f"{tmp_path}/out").count() == 1


def test_settings(spark, tmp_path):
    for name, kind in (("intake", intake.Settings), ("dossiers", dossiers.Settings)):
        assert settings_of(spark, kind, f"{ROOT}/jobs/{name}.json", {}).input
    with pytest.raises(ValueError, match="unknown settings"):
        settings_of(spark, dossiers.Settings, None, {"input": "a", "output": "b", "colour": 1})


needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_tables
def test_dossiers_of_some_places_replace_theirs(spark, tmp_path):
    whole = dossiers.Settings(SF, f"{tmp_path}/out")
    rows = lambda: sorted(map(str, dossiers.read(spark, whole.output).collect()))
    dossiers.run(spark, whole)
    first = rows()
    dossiers.run(spark, whole)
    assert rows() == first
    dossiers.run(spark, dossiers.Settings(SF, whole.output, places=["place1"], per_section=1))
    changed = rows()
    of = lambda rs, p: [r for r in rs if f"'{p}'" in r]
    assert of(changed, "place2") == of(first, "place2") and 0 < len(of(changed, "place1")) < len(of(first, "place1"))
    dossiers.run(spark, dossiers.Settings(SF, whole.output, places=["place1"]))
    assert rows() == first


@needs_tables
def test_dossiers_of_empty_tables(spark):
    views = [dossiers._clusters(spark, SF), dossiers._insights(spark, SF), dossiers.view(spark, SF, "raw")]
    assert dossiers.dossiers(*[v.limit(0) for v in views]).collect() == []
    # Places that only insights name, no raw rows: no quotes, but the verdict and sights.
    rows = dossiers.dossiers(views[0].limit(0), views[1], views[2].limit(0)).collect()
    assert {r["section"] for r in rows} == {"verdict", "sights"}


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_job_query(spark, name):
    import duckdb

    from tests.test_entry import canon

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(SF)):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    df = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canon(df.collect(), df.columns) == canon(want.fetchall(), want.columns)


def test_jobs_need_nothing_of_the_training_operators():
    code = "import sys; sys.modules['gleaner.llm'] = None; sys.modules['corpus_pipeline'] = None; import jobs.queries, jobs.intake, jobs.dossiers"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, timeout=60)
