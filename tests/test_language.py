"""Language from n-gram profiles: held-out accuracy, and the likelihoods by force."""

import math
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.operators import language

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _by_force(rows, texts, most):
    grams = lambda t: Counter(f" {t.lower()} "[k : k + 3] for k in range(len(t)))
    counts = {}
    for lang, t in rows:
        if lang and t:
            counts.setdefault(lang, Counter()).update(grams(t))
    kept = {x: dict(sorted(c.items(), key=lambda e: (-e[1], e[0]))[:most]) for x, c in counts.items()}
    union = set().union(*kept.values())
    out = []
    for t in texts:
        own = {g: n for g, n in grams(t).items() if g in union} if t else {}
        score = {x: sum(n * math.log((kept[x].get(g, 0) + 1) / (sum(counts[x].values()) + len(union))) for g, n in own.items()) for x in sorted(kept)}
        out.append(max(score, key=score.get) if own else None)
    return out


def test_profiles_by_force(spark):
    rows = [("en", "the cat sat on the mat"), ("en", "this is the thing"), ("it", "il gatto sulla sedia della casa"), ("de", "Über der Straße liegt das Haus"), ("", "nothing"), (None, "none"), ("en", None), ("it", "")]
    texts = ["the thing", "della sedia", "DAS HAUS der", "", None, "zzzz qqqq", "a", "x" * 200_000 + " the the", "the thing"]
    df = spark.createDataFrame(rows, "`l.x` string, text string").selectExpr("*", "'x' AS lang", "1 AS gram", "2 AS n")
    for most in (5, 3000):
        found = language.Detector(language.learn(df, "text", "l.x", most=most))
        got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", language.detect(F.col("text"), found).alias("d"))
        assert [r.d for r in got.orderBy("k").collect()] == _by_force(rows, texts, most)
    filled = spark.createDataFrame([(0, "fr", "the thing"), (1, " ", "della sedia"), (2, None, ""), (3, None, "§§"), (4, None, None)], "k int, lang string, text string")
    assert [r.x for r in filled.select("k", language.filled_language(F.col("lang"), F.col("text"), found).alias("x")).orderBy("k").collect()] == ["fr", "it", "en", "en", "en"]


def test_no_profiles(spark):
    none = language.Detector(language.learn(spark.createDataFrame([], "lang string, text string"), "text", "lang"))
    assert spark.range(1).select(language.detect(F.lit("some text"), none).alias("d")).head().d is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").filter("lang <> '' AND length(text) >= 100")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = language.Detector(language.learn(d.filter(~held), "text", "lang"))
    r = d.filter(held).select((language.detect(F.col("text"), found) == F.col("lang")).alias("ok")).agg(F.count("*").alias("n"), F.count_if("ok").alias("good")).head()
    print("held out", r.n, r.good)
    assert r.n >= 20 and r.good >= 0.9 * r.n
