"""Calls of models: a bounded window in flight, stored answers, and failures that cost what they must."""

from __future__ import annotations

import json
import os
import threading
import time
import uuid

import pytest

from gleaner.operators import model_batches


def test_window_is_bounded_and_keeps_order():
    lock, flying, most, taken = threading.Lock(), [0], [0], [0]

    def work(k):
        with lock:
            flying[0] += 1
            most[0] = max(most[0], flying[0])
        time.sleep(0.002 * (k % 3))
        with lock:
            flying[0] -= 1
        return k

    def items():
        for k in range(60):
            taken[0] = k
            yield k

    out = model_batches.in_order(work, items(), 5)
    assert next(out) == 0 and taken[0] <= 5  # no more is taken ahead than the window holds
    assert list(out) == list(range(1, 60))
    assert 2 <= most[0] <= 5
    assert list(model_batches.in_order(work, iter([]), 3)) == []


def recorder(folder, broken=()):
    """A model that leaves a file for each call, and fails or answers badly for some words."""

    class Recorder:
        def call(self, system, user):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(user)
            rows = json.loads(user)
            if any(w in r["text"] for r in rows for w in broken):
                raise ValueError("unreadable")
            return {"results": [{"id": r["id"], "intent_tag": "warning", "numeric_anchors": 5 if "badly" in r["text"] else [r["text"]]} for r in rows]}

    return Recorder()


def asked_in(folder):
    """How often each text was asked for."""
    out = {}
    for name in os.listdir(folder):
        with open(f"{folder}/{name}") as f:
            for r in json.load(f):
                out[r["text"]] = out.get(r["text"], 0) + 1
    return out


@pytest.fixture
def calls(tmp_path):
    os.mkdir(tmp_path / "calls")
    return str(tmp_path / "calls")


def rows_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "n int, text string").repartition(3)


def test_answers_are_asked_for_once(spark, tmp_path, calls):
    texts = [f"text {k % 20}" for k in range(40)] + [None, ""]
    df, at = rows_of(spark, texts), f"{tmp_path}/answers"
    ask = lambda df: {r.n: (r.intent_tag, r.numeric_anchors, r.error) for r in model_batches.tag(df, recorder(calls), batch=4, answers=at).collect()}
    first = ask(df)
    assert first == {k: ("warning", [t] if t else [], None) for k, t in enumerate(texts)}
    assert asked_in(calls) == {f"text {k}": 1 for k in range(20)} | {"": 1}
    assert ask(df) == first and sum(asked_in(calls).values()) == 21  # no call
    ask(rows_of(spark, [*texts, "new"]))
    assert sum(asked_in(calls).values()) == 22 and asked_in(calls)["new"] == 1
    # Other instructions are other questions.
    model_batches.tag(df.limit(1), recorder(calls), system="other", answers=at).collect()
    assert sum(asked_in(calls).values()) == 23


def test_only_failures_are_asked_again(spark, tmp_path, calls):
    texts = [f"text {k}" for k in range(9)] + ["boom"]
    df, at = rows_of(spark, texts).coalesce(1), f"{tmp_path}/answers"
    got = {r.text: r.error for r in model_batches.tag(df, recorder(calls, ["boom"]), batch=1, answers=at, wait=0.0).collect()}
    assert got == {t: "ValueError: unreadable" if t == "boom" else None for t in texts}
    before = asked_in(calls)
    got = {r.text: (r.error, r.intent_tag) for r in model_batches.tag(df, recorder(calls), batch=1, answers=at).collect()}
    assert got == {t: (None, "warning") for t in texts}
    assert {t: n - before[t] for t, n in asked_in(calls).items() if n > before[t]} == {"boom": 1}


def test_a_failed_job_repeats_no_stored_wave(spark, tmp_path, calls):
    df, at = rows_of(spark, [f"text {k}" for k in range(30)]), f"{tmp_path}/answers"

    class Dies(type(recorder(calls))):
        def call(self, system, user):
            if "text 7" in user:
                raise SystemExit("the worker goes down")
            return super().call(system, user)

    with pytest.raises(Exception):  # noqa: B017
        model_batches.tag(df, Dies(), batch=1, answers=at, wave=5).collect()
    stored = {json.loads(r.said)["numeric_anchors"][0] for r in model_batches.stored(spark, at).filter("error IS NULL").collect()}
    before = asked_in(calls)
    assert model_batches.tag(df, recorder(calls), batch=1, answers=at, wave=5).filter("error IS NULL").count() == 30
    again = {t for t, n in asked_in(calls).items() if n > before.get(t, 0)}
    assert not again & stored and again | stored == {f"text {k}" for k in range(30)}


def test_bad_answers_cost_their_own_row(spark, tmp_path, calls):
    df = rows_of(spark, ["one", "badly", "two", None, "three"]).coalesce(1)
    for at in (None, f"{tmp_path}/answers"):
        got = {r.text: r.error for r in model_batches.tag(df, recorder(calls), answers=at).collect()}
        assert {t for t, e in got.items() if e} == {"badly"} and "TypeError" in got["badly"]
    # It isn't an answer, so it isn't stored as one.
    assert model_batches.stored(spark, at).filter("error IS NULL").count() == 4


def test_columns_of_any_name_and_empty_tables(spark, tmp_path, calls):
    df = spark.createDataFrame([("t", 1, 2, 3, "x")], "text string, digest int, shown int, _digest_0 int, error string")
    for at in (None, f"{tmp_path}/answers"):
        (r,) = model_batches.tag(df, recorder(calls), answers=at).collect()
        assert (r.digest, r.shown, r["_digest_0"], r.error, r.intent_tag) == (1, 2, 3, None, "warning")
        assert model_batches.tag(df.limit(0), recorder(calls), answers=at).collect() == []
    with pytest.raises(ValueError, match="at least one"):
        model_batches.tag(df, recorder(calls), parallel=0)
