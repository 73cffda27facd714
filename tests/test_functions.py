from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from gleaner.functions import dates, scores, taxonomy, text

L = F.lit


def test_strip_takes_unicode_space(one):
    assert one(text.strip(L("\t  a b \n\x1f")), text.squeeze(L("a  \n b")), text.strip(L("")), text.strip(L(None).cast("string"))) == ("a b", "a b", "", None)


def test_page_url(one):
    base = L("https://x/Attraction-Reviews-Foo-Reviews-Bar")
    assert one(text.page_url(base, L(0)), text.page_url(base, L(20))) == ("https://x/Attraction-Reviews-Foo-Reviews-Bar", "https://x/Attraction-Reviews-or20-Foo-Reviews-Bar")
    for bad in (text.page_url(base, L(-10)), text.page_url(L("https://x/none"), L(10))):
        with pytest.raises(Exception, match="offset|Reviews"):
            one(bad)


def test_thread_urls(one):
    url = L("https://www.Reddit.com/r/Rome/comments/AbC12/slug/?x=1")
    assert one(text.thread_id(url), text.thread_key(url), text.plain_url(L("HTTPS://a/B//?q")), text.thread_id(L("https://a"))) == ("abc12", "r/rome/abc12", "https://a/b", None)


def test_synthetic_id(one):
    a = text.synthetic_review_id(L(" Ann  B"), L("Great\n view"), L(None).cast("string"), L("June 1, 2026"))
    b = text.synthetic_review_id(L("ann b "), L("great view"), L(""), L("june 1, 2026"))
    c = text.synthetic_review_id(L("ann b"), L("other"), L(""), L("june 1, 2026"))
    x, y, z = one(a, b, c)
    assert x == y != z and x == "syn_" + hashlib.sha256(b"ann b|great view||june 1, 2026").hexdigest()[:16]


def test_clean_markdown(one):
    md = L("# Title\n![i](u) see [the map](http://m) now\n## Next")
    assert one(text.clean_markdown(md)) == ("Title\n see the map now\nNext",)


@pytest.mark.parametrize(
    ("value", "expected"),
    [("short", "short"), ("a" * 500, "a" * 400 + "…"), ("b" * 300 + " " + "c" * 300, "b" * 300 + "…"), ("d" * 100 + " " + "e" * 500, ("d" * 100 + " " + "e" * 500)[:400] + "…"), (None, "")],
)
def test_trim_quote(one, value, expected):
    assert one(text.trim_quote(L(value).cast("string"))) == (expected,)


@pytest.mark.parametrize(("value", "expected"), [("3 hours", 180.0), ("90 mins", 90.0), ("1,5 hours", 90.0), ("2-3 hours", 180.0), ("10am", None), ("", None), ("5 MIN or 2 hours", 5.0)])
def test_minutes(one, value, expected):
    assert one(text.minutes(L(value))) == (expected,)


def test_labels_and_sizes(one):
    assert one(text.humanized(L("skip_the  line")), text.humanized(L("")), text.short_id(L("abcdefghijklmnopq")), text.short_id(L("abc")), text.community_name(L("r/Rome")), text.human_size(L(1536)), text.year(L(""), L("May 1999"))) == (
        "Skip the line.", "An observation worth noting.", "abcd…nopq", "abc", "rome", "1.5 KB", "1999",
    )
    assert one(text.source_label(L("reddit_post"), L("r/x"), L("")), text.source_label(L("blog_page"), L(""), L("")), text.platform(L("google_review"))) == ("Reddit r/x", "blog page", "Google Reviews")


def test_rounding_is_half_even(one):
    assert one(*[scores.rating(L(x)) for x in ("2.5", "3.5", "4.4", "x", "")]) == (2, 4, 4, None, None)


@pytest.mark.parametrize("size", [2, 3, 7, 8, 14, 15])
@pytest.mark.parametrize("best", [2, 3, 4])
def test_tier_boundaries(one, size, best):
    expected = "A" if (best >= 4 and size >= 3) or size >= 15 else "B" if best >= 3 or size >= 8 else "C"
    assert one(scores.quality_tier(L(best), L(1), L(size)), scores.quality_tier(L(1), L(best), L(size))) == (expected, expected)


def test_scores(one):
    assert one(scores.size_sigmoid(L(20))) == (0.5,)
    assert one(scores.video_score(L(500_000), L(25_000), L(5_000)), scores.video_score(L(0), L(0), L(0))) == (1.0, 0.0)
    got = one(scores.hybrid(L(0.5), L("B"), L(10), L(20), L(1.0), L(1.0)))[0]
    assert got == pytest.approx(0.55 * 0.5 + 0.25 * 0.6 + 0.15 + 0.05 * 0.5 + 0.1 - 0.04)
    assert one(scores.insight_score(L(0.5), L("?"), L(None).cast("double"))) == (pytest.approx(0.53),)


def test_query_intent_finds_tokens_in_words():
    assert scores.query_intent("is it worth it") == "positive"
    assert scores.query_intent("any scam?") == "negative"
    assert scores.query_intent("worth it or a scam") is None
    assert scores.query_intent("management") == "positive"
    assert scores.query_intent("management", word_bounded=True) is None


def test_anchor_match_is_word_bounded(one):
    anchors = F.array(L("Mona Lisa"), L("Louvre"))
    hit = lambda q, p="Louvre": one(scores.anchor_match(q, anchors, L(p)))[0]
    assert (hit("see the MONA LISA?"), hit("monalisa"), hit("the louvre"), hit("the louvre", "x")) == (1.0, 0.0, 0.0, 1.0)


def test_freshness(one):
    as_of = "2026-01-01 00:00:00"
    got = one(*[scores.freshness(L(x).cast("string"), as_of) for x in (None, "junk", "2030-01-01", "2024-01-01T12:00:00")])
    assert got[:3] == (0.5, 0.5, 1.0) and got[3] == pytest.approx(math.exp(-(730.5 * 86400) / scores.TAU_SECONDS))


def test_verdict(one):
    assert one(scores.verdict(L(0), L(0), L(0), L(0), L(0)), scores.verdict(L(10), L(10), L(10), L(0), L(10))) == (20, 100)
    assert one(scores.verdict_headline(L(70), L("Colosseum")), scores.verdict_headline(L(None).cast("int"), L("x"))) == ("Go, with conditions.", "Verdict pending.")


def test_dates(one):
    assert one(*[dates.visit_month(L(x)) for x in ("Jun 2026", " june 2026 x", "2026", "Foo 2026")]) == ("2026-06-01", "2026-06-01", None, None)
    assert one(dates.epoch_iso(L(0))) == ("1970-01-01T00:00:00+00:00",)


def test_taxonomy(spark):
    combos = taxonomy.combos(spark, spark.createDataFrame([(" A ", "B", "C"), ("A", None, "x"), ("A", "D", "E")], "l1 string, l2 string, l3 string"))
    assert combos.count() == 2 + len(taxonomy.EXTRA_COMBOS)
    rows = [(1, "A", "B", "C"), (2, "A", "?", "?"), (3, "A", "D", "?"), (4, "?", "B", "C"), (5, "Operational Intelligence", "Facilities", "Seating")]
    got = {r.i: (r.l2, r.l3, r.label_valid) for r in taxonomy.recover(spark.createDataFrame(rows, "i int, l1 string, l2 string, l3 string"), combos).collect()}
    assert got == {1: ("B", "C", True), 2: ("B", "C", False), 3: ("D", "E", False), 4: ("B", "C", False), 5: ("Facilities", "Seating", True)}
    famous = spark.createDataFrame([("Louvre Museum", "x", ["Venus de Milo"], "q", "Hidden Highlight", "r"), ("Louvre Museum", "near the pyramid", [], "q", "Hidden Highlight", "r"), ("Colosseum", "mona lisa", [], "q", "Hidden Highlight", "r")], "poi_name string, name string, anchor_entities array<string>, l1 string, l2 string, l3 string")
    assert [(r.l2, r.l3) for r in taxonomy.override_famous(famous).collect()] == [("Iconic Artwork", "Sculpture"), ("Iconic Landmark", "Monument"), ("Hidden Highlight", "r")]
    assert taxonomy.prompt_lines(combos).filter("l1 = 'A'").head().text == "=== A ===\n  B  →  C\n  D  →  E"
