"""The registered queries of the training-data operators and the pipeline on the smallest tables, and planted edges of theirs."""

from __future__ import annotations

import hashlib
import os
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.llm import chat
from gleaner.llm.queries import ORACLE_SQL, QUERIES
from tests.test_entry import canon

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@tables
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df, want = QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    assert set(want.columns) <= set(df.columns)
    assert canon(df.select(want.columns).collect(), want.columns) == canon(want.fetchall(), want.columns)


@tables
def test_op1_scores_every_document(spark, duck):
    got = {r.doc_id: r for r in QUERIES["op1_quality"](spark, SF).collect()}
    ids = [d for (d,) in duck.sql("SELECT doc_id FROM documents").fetchall()]
    assert sorted(got) == sorted(ids)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in got.items())


@tables
def test_op2_reads_back_all_conversations(spark, duck):
    talks: dict = {}
    for c, t, role, text in duck.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall():
        talks.setdefault(c, []).append((t, role, text or ""))
    talks[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {int(r.conv_id): r for r in QUERIES["op2_chat"](spark, SF).collect()}
    assert set(got) == set(talks)
    for c, turns in talks.items():
        turns.sort()
        loss = "".join(text for _, role, text in turns if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars > len(loss)


@tables
def test_op3_meets_its_targets(spark, duck):
    rows = QUERIES["op3_mixing"](spark, SF).collect()
    source = dict(duck.sql("SELECT doc_id, source FROM documents").fetchall())
    # Ten documents a source here: what is missing is less than the largest of them.
    largest = Counter()
    for r in rows:
        largest[source[r.doc_id]] = max(largest[source[r.doc_id]], r.size)
    assert sorted(r.doc_id for r in rows) == sorted(source)
    assert all(r.taken <= 2 * r.size for r in rows)
    taken, target = Counter(), {}
    for r in rows:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) < largest[s] for s in target)


@tables
def test_op8_and_op9_by_force(spark, duck):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    own, start = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json"))), 0
    got = {r.doc_id: r for r in QUERIES["op8_token_output"](spark, SF).collect()}
    for d, text in sorted(duck.sql("SELECT doc_id, text FROM documents").fetchall()):
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 1]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    vectors = {i: np.array(v, float) for i, v in duck.sql("SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL").fetchall() if all(x is not None for x in v)}
    found: dict = {}
    for r in QUERIES["op9_nearest"](spark, SF).collect():
        found.setdefault(r.query_id, {})[r.rank] = r
    hits = total = 0
    for q, ranks in found.items():
        want = sorted((-float(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q)[: len(ranks)]
        hits += len({i for _, i in want} & {r.vec_id for r in ranks.values()})
        total += len(want)
    assert hits >= 0.9 * total
    assert all(sorted(ranks) == list(range(1, len(ranks) + 1)) for ranks in found.values())


@tables
def test_pipeline_runs_and_loses_no_step(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(got.columns)
    rows = sorted(got.collect(), key=lambda r: r.start)
    assert rows and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))


def test_pipeline_stages_take_any_rows(spark, tmp_path):
    """All stages over nulls, empty texts, repeated rows, clashing and dotted names, and over no rows at all."""
    import corpus_pipeline

    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(90)}" for _ in range(n))
    rows = [(k, text(80), rng.choice(["a", "b", None])) for k in range(30)] + [(None, "x y", "a"), (31, None, "a"), (32, "", None), (33, "t t", "b"), (33, "t t", "b")]
    schema = "doc_id long, text string, source string"
    spark.createDataFrame([(k, k % 2, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("i", text(20))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for own in (rows, []):
        docs = spark.createDataFrame(own, schema).withColumns({c: F.lit("x") for c in ("a.b", "_row", "_bad_row", "_mix_id", "_mix_tie", "score", "shard")})
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            if not own:
                assert docs.isEmpty()


def test_system_turn_at_the_end_of_a_segment(spark):
    """The system turn among a segment's last turns comes once into each later window, not as history beside itself."""
    p = chat.Params(budget=40, history_turns=2, history_budget=1000, segment=8)
    rows = [(1, t, "system" if t == 7 else ("user", "assistant")[t % 2], f"turn {t}") for t in range(30)]
    for w in chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), p).collect():
        turns = chat.parse(w.text)
        assert [r for r, _ in turns].count("system") <= 1
        assert w.segment == 0 or turns[0] == ("system", "turn 7")
