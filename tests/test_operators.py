from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner import models
from gleaner.functions import taxonomy
from gleaner.operators import chunks, cleaning, dedupe, joins, model_batches, rollups, sampling, vectors

L = F.lit


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# ---- dedupe and state ----


def test_first_wins_whatever_the_order(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z"), ("c", 4, "w"), (None, 5, "n"), ("", 6, "e")], "id string, seq int, text string")
    for n in (1, 4):
        assert rows(dedupe.first_wins(df.repartition(n), ["id"], ["seq"], drop_empty=True), "id", "text") == [("a", "x"), ("b", "y"), ("c", "w")]
    assert rows(dedupe.last_wins(df, ["id"], ["seq"]).filter("id = 'a'"), "text") == [("z",)]


def test_upsert_is_idempotent_and_keeps_other_columns(spark):
    old = spark.createDataFrame([("a", 1, "keep"), ("b", 2, "stay")], "id string, n int, extra string")
    new = spark.createDataFrame([("a", 7, 1), ("a", None, 2), ("c", 9, 1)], "id string, n int, seq int")
    once = dedupe.upsert(old, new, ["id"], "seq")
    assert rows(once, "id", "n", "extra") == sorted([("a", None, "keep"), ("b", 2, "stay"), ("c", 9, None)], key=repr)
    assert rows(dedupe.upsert(once, new, ["id"], "seq"), "id", "n", "extra") == rows(once, "id", "n", "extra")
    assert rows(dedupe.upsert(old.limit(0), new, ["id"], "seq"), "id", "n") == sorted([("a", None), ("c", 9)], key=repr)


def test_links_cursors_and_constraints(spark):
    old = spark.createDataFrame([("p", None)], "a string, b string")
    batch = spark.createDataFrame([("p", None), ("q", "z"), ("q", "z")], "a string, b string")
    assert rows(dedupe.insert_new(old, batch, ["a", "b"]), "a", "b") == [("p", None), ("q", "z")]
    wanted = spark.createDataFrame([("p", "newest"), ("q", "newest")], "poi string, mode string")
    stored = spark.createDataFrame([("p", "newest", "tok", True)], "poi string, mode string, token string, exhausted boolean")
    got = dedupe.cursor_of(wanted, stored, ["poi", "mode"], {"token": L(None).cast("string"), "exhausted": L(False)})
    assert rows(got, "poi", "token", "exhausted") == [("p", "tok", True), ("q", None, False)]
    df = spark.createDataFrame([("a", 5, 1), ("a", 4, 2), ("b", 9, 3), ("c", None, 4)], "id string, rating int, seq int")
    good, bad = dedupe.validate(df, {"rating": F.col("rating").between(1, 5), "id": F.col("id").isNotNull()}, ["id"], ["seq"])
    assert rows(good, "seq") == [(1,), (4,)] and rows(bad, "seq", "violations") == [(2, ["unique"]), (3, ["rating"])]
    filled = dedupe.with_defaults(df, {"rating": L(0), "likes": L(0)})
    assert rows(filled.filter("seq = 4"), "rating", "likes") == [(0, 0)]
    p, c = dedupe.delete_cascade(df, batch, df.filter("seq = 3"), "id", "a")
    assert p.count() == 3 and c.count() == 3


# ---- samples ----


def test_round_robin_and_quota(spark):
    df = spark.createDataFrame([(k, "abbbbcc"[k], k % 2) for k in range(7)], "seq int, poi string, band int")
    assert [r.seq for r in sampling.round_robin(df, "poi", "seq", 5).collect()] == [0, 1, 5, 2, 6]
    got = sampling.quota(df, ["poi"], spark.createDataFrame([(0, 1), (1, 5)], "band int, n int"), "band", "seq", "seq")
    assert rows(got, "seq") == [(0,), (1,), (3,), (4,), (5,), (6,)]


def test_two_limits_are_not_merged(spark):
    df = spark.createDataFrame([(k, None if k == 9 else k) for k in range(10)], "id int, n int")
    assert [r.id for r in sampling.overfetch(df, "n", "id", F.col("id") % 2 == 0, 2, 2).collect()] == [8, 6]
    assert [r.id for r in sampling.newest(df, "n", 2, "id").collect()] == [9, 8]


def test_small_samples(one, spark):
    arr = lambda n: F.array(*[L(k) for k in range(n)]).cast("array<int>")
    assert one(*[sampling.first_middle_last(arr(n)) for n in (2, 3, 7)]) == ([], [0, 1, 2], [0, 3, 6])
    assert one(rollups.middle_pick(arr(4)), rollups.middle_pick(arr(4), True), rollups.middle_pick(arr(0))) == (2, 1, None)


# ---- cleaning ----


@pytest.mark.parametrize(
    ("value", "expected"),
    [(None, "empty_text"), (" \n", "empty_text"), ("x" * 400 + " ERROR  404", "error_404"), ("Skip to main content now", "nav_cruft_short"), ("short", "too_short_<250"), ("[a](b)" * 60, "mostly_md_links"), ("word " * 80, None), ("- skip to footer" + "x" * 400, None)],
)
def test_page_drop(one, value, expected):
    assert one(cleaning.page_drop(L(value).cast("string"))) == (expected,)


@pytest.mark.parametrize(
    ("poi", "value", "expected"),
    [("Colosseum", "", "empty_text"), ("Colosseum", "the coliseum", "too_short_<100"), ("Colosseum", "x " * 60 + "COLISEUM", None), ("Louvre Museum", "y " * 60 + "mona  lisa", None), ("Louvre Museum", "z " * 60, "no_poi_term"), ("Big Ben", "q " * 60 + "big ben", None), (None, "q " * 60, "no_poi_term")],
)
def test_thread_drop(one, poi, value, expected):
    assert one(cleaning.thread_drop(L(poi).cast("string"), L(value))) == (expected,)


def test_navigation_agrees_with_python(spark):
    rng = random.Random(1)
    texts = ["\n".join(rng.choice(["menu", "a line of words that is long enough", "x", "", "About us and cookies "]) for _ in range(rng.randrange(9))) for _ in range(200)] + ["", "w" * 60]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.n for r in df.select("t", cleaning.is_navigation(F.col("t")).alias("n")).collect()}
    for t in texts:
        sizes = [len(x) for x in t.split("\n") if x.strip()]
        short, thin = len(t.strip()) < 50, bool(sizes) and sum(sizes) < 25 * len(sizes)
        worded = len(t.strip()) < 200 and any(w in t.lower() for w in cleaning.NAVIGATION)
        assert got[t] == (short or thin or worded)


def test_insight_filters(spark):
    schema = "i int, l1 string, l2 string, rating int, source string, insight_sentiment string, sentiment string, intent_tag string, numeric_anchors array<string>, sub_attraction string, cluster_id int, freshness_score double"
    df = spark.createDataFrame([(1, "A", "B", 4, "s", "positive", None, "warning", ["5 min"], "Big Hall", 3, 0.5), (2, "A", None, None, "t", "", "positive", None, [], None, None, None)], schema)
    ids = lambda f: [r.i for r in df.filter(cleaning.insight_filter(f)).orderBy("i").collect()]
    assert ids(None) == ids({}) == ids({"source": [], "nonsense": 1, "has_numeric": False}) == [1, 2]
    for f in ({"rating_min": 4}, {"rating_max": 5}, {"source": "s"}, {"has_numeric": True}, {"sub_attraction": "HALL"}, {"cluster_id": 3}, {"min_freshness": 0.5}, {"l2": "B"}, {"intent_tag": ["warning"]}):
        assert ids(f) == [1], f
    assert ids({"insight_sentiment": ["positive"], "l1": "A"}) == [1, 2]


# ---- chunks ----


def test_time_chunks_boundary(one):
    seg = lambda ms, t: F.struct(L(ms).alias("start_ms"), L(1000).alias("duration_ms"), L(t).cast("string").alias("text"))
    got = one(chunks.time_chunks(F.array(seg(0, "a "), seg(74_999, None), seg(75_000, " b"), seg(76_000, "c"))))[0]
    assert [tuple(x) for x in got] == [(0, 75_999, "a"), (75_000, 77_000, "b c")]
    assert one(chunks.time_chunks(F.array().cast("array<struct<start_ms:int,duration_ms:int,text:string>>"))) == ([],)


def sentence_chunks_by_force(text, target):
    import re

    out, buf, n = [], [], 0
    for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", text)):
        if not s:
            continue
        if len(s) + 1 > target * 1.5:
            out += [" ".join(buf)] if buf else []
            out += [s[k : k + target].strip() for k in range(0, len(s), target)]
            buf, n = [], 0
        elif n + len(s) + 1 > target and buf:
            out.append(" ".join(buf))
            buf, n = [s], len(s) + 1
        else:
            buf.append(s)
            n += len(s) + 1
    return [c for c in [*out, " ".join(buf)] if c]


def test_sentence_chunks(spark):
    rng = random.Random(2)
    texts = [" ".join("w" * rng.randrange(1, 9) + rng.choice(["", ".", "!", "?"]) for _ in range(rng.randrange(80))) for _ in range(80)] + ["z" * 500 + ". a", "", "  "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chunks.sentence_chunks(F.col("t"), 50).alias("c")).collect():
        assert r.c == sentence_chunks_by_force(r.t, 50)
    long = spark.createDataFrame([("x", "One two. " * 30, {"k": "v"}), ("y", "short", None)], "source_id string, text string, meta map<string,string>")
    got = {r.source_id: r.meta for r in chunks.chunk_rows(long, 50, 100).collect()}
    assert got["y"] is None and got["x_chunk_0"] == {"k": "v", "chunk_index": "0", "chunk_total": str(len(got) - 1), "parent_id": "x"}


def test_paragraph_chunks(spark):
    p = "This is a sentence of a paragraph that is rather long. "
    md = "# Head\n\n" + (p * 4) + "\n\n" + (p * 4) + "\n\n" + (p * 40) + "\n\nMenu\n\n" + p
    got = [r.chunk for r in chunks.paragraph_chunks(spark.createDataFrame([(1, md), (2, None)], "id int, md string"), "md", ["id"]).orderBy("chunk_index").collect()]
    assert got and all(len(c) <= 800 for c in got) and len({c[:120].lower() for c in got}) == len(got)
    assert got[0].startswith("Head") and "#" not in got[0]


def test_paragraph_packs(one):
    """Each rule by itself, with small sizes: 20 to 100 characters, so a chunk is full from 70 on."""
    pack = lambda text: one(chunks.paragraph_packs(L(text), 20, 100))[0]
    a, b, c = "a" * 40, "b" * 45, "c" * 80
    assert pack("") == [] and pack("a" * 69) == []  # a rest under 80 is dropped
    assert pack(c) == [c]
    assert pack(f"{a}\n\n{b}\n \n{c}") == [f"{a}\n\n{b}", c]  # gathered until full
    assert pack(f"{a}\n\n{'d' * 65}\n\n{c}") == [a, "d" * 65, c]  # closed before what doesn't fit
    s = "This is a sentence of some forty letters."
    assert pack(" ".join([s] * 5)) == [f"{s} {s}"] * 2  # the rest, one sentence, is dropped
    assert pack(" ".join([s] * 5) + f"\n\n{a}") == [f"{s} {s}"] * 2 + [f"{s}\n\n{a}"]  # the rest gathers on
    assert pack("x" * 150 + ". " + s) == ["x" * 150 + "."]  # no sentence is cut
    assert pack(f"{b}\n\n" + " ".join([s] * 3)) == [b, f"{s} {s}"]  # a long paragraph closes what was gathered


# ---- joins ----


def test_link_explosion_and_templates(spark):
    found = spark.createDataFrame([("p1", "planning"), ("p1", "food"), ("gone", "food")], "post_id string, intent string")
    posts = spark.createDataFrame([("p1",), ("p2",)], "id string")
    comments = spark.createDataFrame([("c1", "p1"), ("c2", "p1"), ("c3", "p1"), ("c4", "p2")], "id string, post_id string")
    assert joins.link_explosion(found, posts, comments).count() == 8
    pois = spark.createDataFrame([("Louvre Museum", ["Louvre", "louvre museum"]), ("Big Ben", None)], "name string, aliases array<string>")
    got = joins.search_queries(spark, pois)
    plain, aliased = len(joins.TEMPLATES), sum(a for *_, a in joins.TEMPLATES)
    assert got.filter("name = 'Big Ben'").count() == plain and got.filter("name = 'Louvre Museum'").count() == plain + aliased
    assert {r.intent_category for r in got.filter("query_term LIKE '%Louvre' OR query_term LIKE 'is Louvre %'").collect()} == {"planning", "worth_it", "trip_report"}


def test_evidence_prefers_new_sources(spark):
    clusters = spark.createDataFrame([(1, [2], [0, 1, 2, 3, 4, 99])], "cluster_id int, centroid_text_indices array<bigint>, member_indices array<bigint>")
    ins = spark.createDataFrame([(k, s, str(k), None) for k, s in enumerate(["a", "a", "b", "b", "c"])], "flat_idx bigint, source string, source_id string, anchor_entity string")
    raw = spark.createDataFrame([(s, str(k), f"text {k}" if k != 1 else "", k, "u") for k, s in enumerate(["a", "a", "b", "b", "c"])], "source string, source_id string, text string, rating int, source_url string")
    ids = lambda n: [r.source_id for r in joins.evidence(clusters, ins, raw, n).orderBy("rank").collect()]
    assert (ids(5), ids(2), ids(1)) == (["2", "0", "4", "3"], ["2", "0"], ["2"])
    with pytest.raises(ValueError, match="quote"):
        ids(0)


def test_lookups(spark):
    cits = spark.createDataFrame([("s", "1", ""), ("s", "2", "own"), ("s", "3", None)], "source string, source_id string, source_url string")
    raw = spark.createDataFrame([("s", "1", "u1", 1), ("s", "1", "u1b", 2)], "source string, source_id string, source_url string, ord int")
    assert rows(joins.fill_urls(cits, raw.filter("ord = 1")), "source_id", "source_url") == [("1", "u1"), ("2", "own"), ("3", None)]
    assert rows(joins.raw_lookup(cits.drop("source_url"), raw, "ord", ["source_url"]), "source_id", "raw_source_url") == [("1", "u1b"), ("2", None), ("3", None)]
    clusters = spark.createDataFrame([(2, "late", [1, 2]), (1, "early", [2, 3])], "cluster_id int, name string, member_indices array<bigint>")
    assert rows(joins.cluster_of_members(clusters, ["name"]), "flat_idx", "name") == [(1, "late"), (2, "early"), (3, "early")]
    assert rows(joins.overlap(clusters, clusters.filter("cluster_id = 1"), "cluster_id"), "cluster_id", "found_in") == [(1, "both"), (2, "first")]


# ---- vectors ----


def linkage_by_force(x, threshold):
    unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
    d = 1 - unit @ unit.T
    groups = [[k] for k in range(len(x))]
    while len(groups) > 1:
        best = min(((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        if best[0] >= threshold:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


def test_average_linkage():
    rng = np.random.default_rng(3)
    for n in (2, 5, 40):
        x = rng.normal(size=(n, 6)) + 3 * rng.normal(size=(4, 6))[rng.integers(0, 4, n)]
        assert {frozenset(g) for g in vectors.average_linkage(x, 0.28)} == linkage_by_force(x, 0.28)


def test_merge_needs_a_shared_anchor():
    x = np.array([[1.0, 0], [1, 0.01], [1, 0.02], [0, 1]])
    groups = [[0], [1], [2], [3]]
    assert vectors.merge_by_anchor(groups, x, ["hall", " HALL ", "rome", None]) == [[0, 1], [2], [3]]
    assert len(vectors.merge_by_anchor(groups, x, ["rome"] * 4)) == 4


def test_cluster_places_and_ids(spark):
    data = [("b", k, [1.0, k / 50], "x") for k in range(3)] + [("a", 10 + k, [0.0, 1.0], None) for k in range(4)] + [("a", 20, [1.0, 0.0], None)]
    df = spark.createDataFrame(data, "poi_name string, flat_idx bigint, embedding array<double>, anchor_entity string")
    got = vectors.number_clusters(vectors.cluster_places(df), df)
    assert rows(got, "cluster_id", "poi_name", "size") == [(0, "b", 3), (1, "a", 4), (2, "a", 1)]


def test_large_places_are_clustered_whole(spark):
    """A place beyond MOST_A_PLACE gives all of its insights, and linkage without the matrix the same clusters."""
    rng = np.random.default_rng(8)
    for n in (2, 3, 40, 300):
        x = rng.normal(size=(n, 6)) + 3 * rng.normal(size=(9, 6))[rng.integers(0, 9, n)]
        x[n // 2 :] = x[: n - n // 2] if n == 300 else x[n // 2 :]
        x[-1] = 0 if n == 40 else x[-1]
        roots = list(range(n))
        for height, a, b in vectors._merges_by_mean(x, 0.28):
            if height < 0.28:
                roots = [min(roots[a], roots[b]) if r in (roots[a], roots[b]) else r for r in roots]
        assert {frozenset(np.flatnonzero(np.array(roots) == r).tolist()) for r in roots} == {frozenset(g) for g in vectors.average_linkage(x, 0.28)}
    many = vectors.MOST_A_PLACE + 1
    df = spark.range(many).selectExpr("'p' AS poi_name", "id AS flat_idx", "array(double(id % 2), double(1 - id % 2)) AS embedding", "'rome' AS anchor_entity")
    got = vectors.cluster_places(df).collect()
    assert sorted(r.size for r in got) == [many // 2, many - many // 2]
    assert sorted(i for r in got for i in r.member_indices) == list(range(many))


def test_diverse_selection_is_gated():
    v = np.eye(3)[[0, 0, 1]]
    assert vectors.select_diverse(np.array([0.9, 0.86, 0.80]), v, 2) == [0, 2]
    assert vectors.select_diverse(np.array([0.9, 0.85, 0.80]), v, 2) == [0, 1]
    assert vectors.select_diverse(np.array([0.9]), v[:1], 5) == [0]


def test_stand_in_models(spark, one):
    e = models.HashingEmbedder(16)
    assert np.allclose(e.embed(["a b"]), e.embed(["B  A"])) and abs(np.linalg.norm(e.embed(["x y z"])) - 1) < 1e-5
    df = spark.createDataFrame([("s", "1", "One two three four. x. Five six seven eight."), ("s", "2", None)], "source string, source_id string, text string")
    assert [len(r.insights) for r in models.extract_insights(df, models.first_sentences).orderBy("source_id").collect()] == [2, 0]

    def broken(text):
        raise RuntimeError("down")

    summary = rollups.extraction_summary(models.extract_insights(df, broken)).head()
    assert (summary.n_rows, summary.n_insights, summary.n_errors) == (2, 0, 2)

    class Flaky:
        calls = 0

        def call(self, system, user):
            self.calls += 1
            if self.calls < 3:
                raise ConnectionError
            return {"ok": 1}

    waits = []
    assert models.call_with_retries(Flaky(), "", "", sleep=waits.append) == {"ok": 1} and waits == [2.0, 4.0]
    assert one(models.rule_tag(L("Avoid this scam, 5 min"))["intent_tag"]) == ("warning",)


def said(answer):
    """A model that says what it is told to, and fails on a marked row."""

    class Said:
        def call(self, system, user):
            if "boom" in user:
                raise ValueError("unreadable")
            return answer

    return Said()


def test_answers_are_matched_by_key_then_place():
    rows = [{"id": 0}, {"id": 1}, {"id": 2}]
    said = [{"id": "1", "v": "old"}, {"id": 1, "v": "one"}, "no object"]
    assert model_batches.matched(rows, said, "id") == [{}, {"id": 1, "v": "one"}, {}]
    assert model_batches.matched(rows, said, "id", by_place=True) == [{"id": "1", "v": "old"}, {"id": 1, "v": "one"}, {}]
    assert model_batches.matched(rows, None, "id", by_place=True) == [{}, {}, {}]


def test_failed_batches_keep_their_rows(spark):
    c = spark.createDataFrame([(1, "a", 20), (2, "boom", 20), (3, None, 2)], "cluster_id int, name string, size int").coalesce(1)
    told = said({"scores": [{"cluster_id": 1, "named_entity_score": 0, "actionability_score": 5, "sentiment": ""}, {"cluster_id": 3, "specificity": 4}]})
    got = {r.cluster_id: r for r in model_batches.score(c, told, batch=1).collect()}
    assert [(got[k].named_entity_score, got[k].actionability_score, got[k].specificity, got[k].sentiment, got[k].quality_tier) for k in (1, 2, 3)] == [(3, 5, 5, "neutral", "A"), (3, 3, 3, "neutral", "C"), (4, 4, 4, "neutral", "B")]
    assert got[1].error is None and got[2].error == "ValueError: unreadable"
    assert model_batches.score(c, told, batch=3).filter("error IS NOT NULL").count() == 3  # a batch fails as a whole
    assert model_batches.score(c.limit(0), told).count() == 0


def test_labels_are_recovered_then_overridden(spark):
    schema = "cluster_id int, poi_name string, name string, size int, anchor_entities array<string>"
    c = spark.createDataFrame([(1, "Louvre Museum", "x", 1, ["Mona Lisa "]), (2, "p", "x", 1, None), (3, "p", "boom", 1, []), (4, "p", "x", 1, [])], schema)
    approved = spark.createDataFrame([("Discovery Intelligence", "Hidden Highlight", "Alley")], "l1 string, l2 string, l3 string")
    told = said({"labels": [
        {"cluster_id": 1, "l1": "Discovery Intelligence", "l2": "Hidden Highlight", "l3": "Alley", "confidence": 0.9},
        {"cluster_id": 2, "l1": "Discovery Intelligence", "l2": "Nothing", "l3": "None", "confidence": 0, "secondary_l1": "", "reasoning": "why"},
    ]})
    got = {r.cluster_id: r for r in model_batches.label(c, told, taxonomy.combos(spark, approved), batch=1).collect()}
    assert (got[1].l1, got[1].l2, got[1].l3, got[1].label_valid, got[1].label_reasoning) == ("Attention Intelligence", "Iconic Artwork", "Painting", True, "[famous-anchor-override]")
    assert (got[2].l2, got[2].l3, got[2].label_valid, got[2].label_confidence, got[2].secondary_l1, got[2].label_reasoning) == ("Hidden Highlight", "Alley", True, 0.5, None, "why [auto-recovered]")
    assert (got[3].l1, got[3].label_valid, got[3].label_confidence, got[3].error) == ("", False, 0.0, "ValueError: unreadable")
    assert (got[4].l1, got[4].label_valid, got[4].label_confidence) == ("", False, 0.7)


def test_tags_and_names_by_model(spark):
    r = spark.createDataFrame([(k, t) for k, t in enumerate(["one", "two", None])], "n int, text string").coalesce(1)
    told = said({"results": [{"id": 1, "insight_sentiment": "mixed", "numeric_anchors": ["5 min", "", None]}, {"insight_sentiment": "negative", "sub_attraction": "none"}]})
    got = {x.n: x for x in model_batches.tag(r, told).collect()}
    assert [(got[k].insight_sentiment, got[k].intent_tag, got[k].numeric_anchors, got[k].sub_attraction) for k in (0, 1, 2)] == [("mixed", "other", ["5 min"], None), ("mixed", "other", ["5 min"], None), ("neutral", "other", [], None)]
    c = spark.createDataFrame([(1, "p", 2, [7, 5]), (2, "p", 1, [6]), (3, "p", 1, [])], "cluster_id int, poi_name string, size int, centroid_text_indices array<int>")
    i = spark.createDataFrame([(5, "s", "far"), (6, "s", "boom near"), (7, "s", "near")], "flat_idx int, source string, text string")
    named = {x.cluster_id: x for x in model_batches.name(c, i, said({"names": [{"cluster_name": " N ", "polarity": " Mixed "}]})).collect()}
    assert (named[1].name, named[1].polarity, named[1].anchor_entities, named[1].name_confidence) == ("N", "mixed", [], 0.7)
    assert (named[2].name, named[2].polarity, named[2].name_confidence, named[2].error) == ("boom near", None, 0.0, "ValueError: unreadable")
    assert named[3].name == "N"


def test_throttle_and_limits():
    now, slept = [100.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    for step in (0, 3, 30):
        now[0] += step
        models.throttle("a test", 10, lambda: now[0], sleep)
    assert slept == [7.0]
    answers = iter([(429, {}), (429, {}), (200, {"ok": 1}), (404, {}), (429, {}), (429, {}), (429, {})])
    waits = []
    assert [models.fetch_limited(lambda: next(answers), wait=4.0, sleep=waits.append) for _ in range(3)] == [{"ok": 1}, None, None]
    assert waits == [4.0, 8.0, 4.0, 8.0, 16.0]
    assert models.fetch_limited(lambda: 1 / 0) is None
