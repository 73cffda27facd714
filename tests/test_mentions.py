"""Many names at once, against a search for each."""

import random
import re

import pytest

from gleaner.operators import mentions


def _by_force(rows, names):
    out = []
    for key, text in rows:
        for name in {n.lower() for n in names if n}:
            head, tail = (r"(?<!\w)" if re.match(r"\w", name) else ""), (r"(?!\w)" if re.search(r"\w\Z", name) else "")
            n = len(re.findall(f"(?={head}{re.escape(name)}{tail})", (text or "").lower()))
            if n and key is not None:
                out.append((key, name, n))
    return sorted(out)


@pytest.mark.parametrize("block", [4_000_000, 25])
def test_many_names(spark, block):
    rng = random.Random(6)
    names = ["Colosseum", "colosseum", "the Colosseum", "arena", "are", "a a", "#1", "C++", "Überfahrt", "", None, "naïve_x", "."]
    pool = ["Colosseum", "the", "arena", "arenas", "a", "#1", "#12", "c++", "überfahrt", "naïve_x", "naïve", ".", "\n", "x.are"]
    rows = [(k, " ".join(rng.choice(pool) for _ in range(30))) for k in range(40)] + [(50, None), (51, ""), (None, "arena"), (7, "a a a a"), (52, "arena," * 50_000), (53, "colosseumarena arena_ (are)")]
    df = spark.createDataFrame(rows, "id long, text string").selectExpr("*", "'x' AS key", "1 AS low", "2 AS n", "'arena' AS name")
    own = spark.createDataFrame([(n,) for n in names], "`a.b` string")
    got = mentions.count_mentions(df, "id", "text", own, "a.b", block)
    assert got.columns == ["id", "name", "n"]
    assert sorted(tuple(r) for r in got.collect()) == _by_force(rows, names)


def test_no_names_no_texts(spark):
    none = spark.createDataFrame([], "name string")
    df = spark.createDataFrame([("a", "b c")], "id string, text string")
    assert mentions.count_mentions(df, "id", "text", none).count() == 0
    assert mentions.count_mentions(df.limit(0), "id", "text", df.selectExpr("'b' AS name")).count() == 0
    assert [tuple(r) for r in mentions.count_mentions(df, "id", "text", df.selectExpr("'B C' AS name")).collect()] == [("a", "b c", 1)]
