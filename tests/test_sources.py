from __future__ import annotations

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from gleaner.plans import catalog, feeds  # noqa: F401
from gleaner.sources import parsers, readers
from gleaner.streaming import ingest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def json_df(spark, items, schema=None):
    rdd = spark.createDataFrame([(json.dumps(i),) for i in items], "j string")
    return rdd.select(F.from_json("j", schema).alias("r")).select("r.*")


def test_review_pages(spark):
    schema = "reviews array<struct<review_id:string,rating:double,date:string,iso_date:string,snippet:string,extracted_snippet:struct<original:string>,likes:int,user:struct<name:string>>>"
    page = {"reviews": [{"review_id": "a", "rating": 5.0, "snippet": "", "extracted_snippet": {"original": "deep"}, "user": {"name": "N"}}, {"review_id": "", "rating": 1}, {"review_id": "b", "rating": 2.5, "snippet": "top", "likes": 3}]}
    got = [(r.review_id, r.rating, r.text, r.likes, r.author) for r in parsers.review_pages(json_df(spark, [page, {}], schema)).collect()]
    assert got == [("a", 5, "deep", 0, "N"), ("b", 2, "top", 3, None)]


def test_review_items_dedupe_before_length(spark):
    schema = "reviewId string, name string, stars int, text string, publishedAtDate string, likesCount int, isLocalGuide boolean, reviewerNumberOfReviews int, responseFromOwnerText string, reviewUrl string, originalLanguage string, seq int"
    items = [{"reviewId": "a", "text": "Ok", "seq": 1}, {"reviewId": "a", "text": "x" * 90, "seq": 2}, {"reviewId": "b", "text": f"  {'y' * 75} ", "stars": 4, "seq": 3}, {"reviewId": None, "text": "z" * 90, "seq": 4}]
    got = parsers.review_items(json_df(spark, items, schema), "highestRanking", "seq").collect()
    assert [(r.review_id, len(r.text), r.rating, r.likes, r.sort_mode) for r in got] == [("b", 75, 4, 0, "highest")]


def test_markdown_reviews(spark):
    link = "https://www.tripadvisor.com"
    full = f"[![a](p)]({link}/Profile/img)\n[First]({link}/Profile/first)\n[Ann B]({link}/Profile/annb)\n4.0 of 5 bubbles\n### [Great place]({link}/ShowUserReviews-g1-d2-r999-X.html)\nAug 2025 • Couples\nLine one.\n![i](u)\nLine two.\nRead more\nWritten August 30, 2025\n"
    plain = f"[Bob]({link}/Profile/bob)\n5 of 5 bubbles\n\nPlain title\nJan 2024\nBody here\nWritten January 3, 2024\n"
    none = "5 of 5 bubbles\nJun 2024\nBody\nWritten June 3, 2024\n"
    page = "\n* * *\n".join([full, "no review", plain, full, none])
    got = parsers.markdown_reviews(spark.createDataFrame([(1, page), (2, None)], "page int, markdown string"), "page").orderBy("pos").collect()
    assert [(r.review_id[:4], r.author, r.author_profile, r.rating, r.title, r.body, r.visit_date, r.trip_type, r.written_date) for r in got] == [
        ("r999", "Ann B", "annb", 4, "Great place", "Line one.\n\nLine two.", "Aug 2025", "Couples", "August 30, 2025"),
        ("syn_", "Bob", "bob", 5, "Plain title", "Body here", "Jan 2024", None, "January 3, 2024"),
    ]


def test_captions_and_videos(spark):
    events = json_df(spark, [{"events": [{"tStartMs": 5, "segs": [{"utf8": "a\n"}, {"utf8": "b"}]}, {"tStartMs": 9}, {"segs": [{"utf8": " \n"}]}, {"dDurationMs": 7, "segs": [{"utf8": "c"}]}]}], "events array<struct<tStartMs:bigint,dDurationMs:bigint,segs:array<struct<utf8:string>>>>")
    s = events.select(parsers.caption_segments(F.col("events")).alias("s"))
    assert [tuple(x) for x in s.head().s] == [(5, 0, "a b"), (0, 7, "c")]
    assert s.select(parsers.full_text(F.col("s"))).head()[0] == "a b c"
    raw = json_df(spark, [{"raw": [{"start": "1.5", "dur": "2", "text": "x\ny"}, {"start": "?", "dur": "1", "text": "z"}, {"start": "1", "dur": "1", "text": " "}]}], "raw array<struct<start:string,dur:string,text:string>>")
    assert [tuple(x) for x in raw.select(parsers.actor_segments(F.col("raw"))).head()[0]] == [(1500, 2000, "x y")]
    v = json_df(spark, [{"id": "a", "duration": 60.0}, {"id": "b", "duration": 61.5, "view_count": 5}], "id string, title string, duration double, view_count bigint, like_count bigint, comment_count bigint, upload_date string")
    assert [(r.format, r.views, r.duration_seconds, r.title) for r in parsers.video_rows(v).collect()] == [("short", 0, 60, ""), ("long", 5, 61, "")]


def test_model_answers_are_made_sane(spark):
    schema = "insights array<struct<text:string,strength:double,anchor_entity:string>>"
    df = json_df(spark, [{"insights": [{"text": ""}, {"text": "a", "strength": 0.0, "anchor_entity": ""}, {"text": "b", "strength": 0.9, "anchor_entity": "x"}, {"text": "c"}]}], schema)
    assert [tuple(x) for x in df.select(parsers.sane_insights(F.col("insights"))).head()[0]] == [("a", 0.5, None), ("b", 0.9, "x")]
    tag = json_df(spark, [{"t": {"insight_sentiment": "odd", "intent_tag": "warning", "numeric_anchors": ["", "5 min"], "sub_attraction": " None "}}], "t struct<insight_sentiment:string,intent_tag:string,numeric_anchors:array<string>,sub_attraction:string,visit_date_mentioned:string>")
    assert tuple(tag.select(parsers.sane_tag(F.col("t"))).head()[0]) == ("neutral", "warning", ["5 min"], None, None)
    inputs = spark.createDataFrame([(0, 10), (1, 11)], "pos int, id int")
    back = spark.createDataFrame([(0, 11, "eleven"), (1, None, "second")], "pos int, id int, result string")
    assert sorted((r.id, r.result) for r in parsers.aligned(inputs, back).collect()) == [(10, "eleven"), (11, "eleven")]


def test_item_kinds(spark):
    keys = ["dataType", "type", "postType", "commentId", "parentId", "title", "url", "body"]
    rows = [({"dataType": "post"}, "post"), ({"type": "submission"}, "post"), ({"parentId": "x"}, "comment"), ({"title": "t", "url": "u"}, "post"), ({"body": "b"}, "comment"), ({"title": "t"}, "other")]
    df = spark.createDataFrame([tuple(r.get(k) for k in keys) for r, _ in rows], ", ".join(f"{k} string" for k in keys))
    assert [r[0] for r in df.select(parsers.item_kind({k: F.col(k) for k in keys})).collect()] == [e for _, e in rows]


def test_readers(spark, tmp_path):
    assert readers.json_rows(spark, f"{tmp_path}/none.json", "a int").count() == 0
    (tmp_path / "x.json").write_text('[{"a": 1}, {"a": 2}]')
    assert readers.first_of(spark, [f"{tmp_path}/none.json", f"{tmp_path}/x.json"], "a int").count() == 2
    with pytest.raises(FileNotFoundError):
        readers.first_of(spark, [f"{tmp_path}/none.json"], "a int")
    r = readers.Registry()
    r.add("one", lambda s: s.createDataFrame([(1,)], "a int"))
    r.add("two", lambda s: s.createDataFrame([(2, "own")], "b int, source string"))
    assert sorted((x.a, x.b, x.source) for x in r.read(spark).collect() if x.a) == [(1, None, "one")]
    with pytest.raises(KeyError):
        r.read(spark, ["three"])


def test_paged_feed_resumes(spark, tmp_path):
    pages = json.dumps([[{"i": 1}, {"i": 2}], [{"i": 3}], [], [{"i": 9}]])
    readers.register(spark)
    assert [r.offset for r in spark.read.format("paged_feed").option("pages", pages).load().orderBy("offset").collect()] == [0, 1, 10]
    stream = ingest.read_feed(spark, pages).select(F.get_json_object("item", "$.i").alias("id"), "offset")
    for _ in range(2):  # the second run has nothing new
        q = ingest.upsert_stream(stream, f"{tmp_path}/t", f"{tmp_path}/c", "id", "offset").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(r.id for r in ingest.current(spark, f"{tmp_path}/t", "id", "offset").collect()) == ["1", "2", "3"]


def test_progress(spark, tmp_path):
    events = [("a", k, *e) for k, e in enumerate([("page", 5), ("page", 0), ("error", 0), ("page", 2), ("error", 0), ("error", 0), ("error", 0), ("page", 9)])] + [("b", 0, "page", 1), ("b", 1, "end", 0), ("b", 2, "page", 4)]
    df = spark.createDataFrame(events, "poi_id string, seq long, kind string, n_reviews int")
    expected = {}
    for p, _, kind, n in events:
        expected.setdefault(p, ingest.Progress()).see(kind, n)
    want = sorted((p, x.next_offset, x.error_streak, x.pages, x.reviews, x.exhausted) for p, x in expected.items())
    assert sorted(tuple(r) for r in ingest.fold_progress(df).collect()) == want
    df.write.parquet(f"{tmp_path}/e")
    q = ingest.track_progress(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/e")).writeStream.outputMode("update").format("memory").queryName("progress").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("progress").collect()) == want
    assert ingest.token_step({"next_page_token": "t", "exhausted": False}, None) == {"next_page_token": "t", "exhausted": False}
    assert ingest.token_step({"next_page_token": "t", "exhausted": False}, {"reviews": [1], "next_page_token": "u"}) == {"next_page_token": "u", "exhausted": False}
    assert ingest.token_step({"next_page_token": "t", "exhausted": False}, {"reviews": []})["exhausted"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_feeds_of_whole_documents(spark):
    """Every document reaches the parsers with its whole text, line breaks and markup included."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    pages = {int(r.review_id): r.text for r in catalog.QUERIES["review_pages"](spark, SF).collect()}
    assert pages == {k: t if k % 2 == 0 and t else "original: " + t for k, t in texts.items()}
    items = {int(r.review_id): r.text for r in catalog.QUERIES["review_items"](spark, SF).collect()}
    assert items == {k: t.strip() for k, t in texts.items() if len(t.strip()) >= 75}
    bodies = {int(r.review_id[1:]) - 1: r.body for r in catalog.QUERIES["markdown_reviews"](spark, SF).collect()}
    assert bodies == {k: re.sub(r"!\[[^\]]*\]\([^)]+\)", "", t).strip() or None for k, t in texts.items()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_sources_and_links_of_whole_tables(spark):
    """Every document has its source; every conversation that can be linked is, posts and comments."""
    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert {r.flat_idx for r in catalog.QUERIES["source_registry"](spark, SF).collect()} == docs
    talks = {(r.conv_id, r.turn) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn").collect()}
    n = max(c for c, _ in talks) + 1
    linked = {r.l_orderkey % n for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").collect()}
    got = {(r.item_type, r.item_id) for r in catalog.QUERIES["link_explosion"](spark, SF).collect()}
    assert {c for c, _ in talks} <= linked
    assert got == {("post", c) for c, _ in talks} | {("comment", c * 100 + t) for c, t in talks if t > 0}


def test_recorded_feed_ends_at_an_empty_page(spark, tmp_path):
    lines = [("a", 0, [{"i": 1}, {"i": 2}]), ("a", 1, []), ("a", 2, [{"i": 9}]), ("b", 0, [{"i": 3}]), ("b", 1, [{"i": 4}]), ("c", 0, None)]
    (tmp_path / "f.jsonl").write_text("\n".join(json.dumps({"poi_id": p, "token": t, "items": i}) for p, t, i in lines))
    got = readers.recorded_feed(spark, f"{tmp_path}/f.jsonl").select("poi_id", "offset", F.get_json_object("item", "$.i").alias("i"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", 0, "1"), ("a", 1, "2"), ("b", 0, "3"), ("b", 10, "4")]
    assert len(readers.last_built(spark, f"{tmp_path}/f.jsonl")) == 19


def test_discussion_links(spark):
    rows = [("https://www.reddit.com/r/x/comments/1/t/", "t", "d"), ("https://www.reddit.com/r/x/", "t", "d"), ("https://example.org/comments/1", "t", "d"), (None, "t", "d")]
    df = spark.createDataFrame(rows, "url string, title string, description string")
    assert [tuple(r) for r in parsers.discussion_links(df).collect()] == [rows[0]]
