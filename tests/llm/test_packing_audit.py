"""Best-fit packing and the filter audit against brute force, and their queries' edge cases."""

from __future__ import annotations

import random
import zlib
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import byte_tokens, filter_audit, packing
from gleaner.llm.queries import ORACLE_SQL, QUERIES
from gleaner.llm.tokens import tokenizer_file

DOCS = "doc_id long, text string, lang string, sequence_id long, ids string, part string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file(packing.TOKENIZER))


HARD = [
    "", "it's  a\n\n test'll 've''s  \n", "<|endoftext|> x <|endoftext|>", "  \t\n a", "don't've 'sabc 'S x1y22  ", "é ñ'd\r\n\tx'", "—“q” naïve… 中文 \x1f a\x85b",
    "Привет  мир !", " 's", "'", "''s 're've", "\n's", "\0 zero\0", "a b   c", "x" * 5000, " " * 300 + "\n",
]


def test_byte_tokens_are_the_librarys(library):
    rnd = random.Random(7)
    texts = HARD + ["".join(rnd.choice("aé1Ω ' \n\ts.rveltmd'— ") for _ in range(rnd.randint(0, 24))) for _ in range(2000)]
    ids, n = byte_tokens.ByteTokenizer(packing.TOKENIZER, most=500).encode(texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.just(40))
def test_swaps_keep_pieces_and_never_add_bins(sizes, room):
    first = packing.best_fit(sizes, room)
    squares = lambda bins: sum(sum(sizes[i] for i in b) ** 2 for b in bins)
    before, n = squares(first), len(first)
    bins = packing.improve(first, sizes, room)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= room for b in bins)
    assert len(bins) <= n and squares(bins) >= before


def test_swaps_find_what_best_fit_misses():
    rnd = random.Random(11)
    sizes = [rnd.randint(200, 700) for _ in range(2000)]
    assert len(packing.pack_sizes(sizes, 1024)) <= len(packing.best_fit(sizes, 1024)) - 4


def packed_rows(df):
    return [r.asDict() for r in packing.pieces(df).collect()]


def check_packing(rows, texts, library, room):
    """Every document's tokens once, in places without gaps; returns the number of sequences."""
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for k, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(ids)
    for k, own in by_doc.items():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and len(own) == -(-len(ids[k]) // room)
        at = 0
        for j, r in enumerate(own):
            assert r["start"] == at and (r["length"] == room or j == 0)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[k][at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids[k])
    for places in by_sequence.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= room
    return len(by_sequence)


def test_packing_of_whole_documents(spark, library, monkeypatch):
    rnd = random.Random(3)
    texts = {k: " ".join(rnd.choice(["wort", "l'été", "don't", "x9", "—"]) for _ in range(rnd.choice([0, 1, 5, 20, 60, 300]))) for k in range(300)}
    texts |= {1000: None, 1001: "", 1002: "<|endoftext|>", 1003: "word " * 3000}
    df = spark.createDataFrame([(k, t, "en", 1, "clash", "p") for k, t in texts.items()], DOCS).repartition(3)
    rows = packed_rows(packing.pack(df, 64))
    n = check_packing(rows, texts, library, 64)
    assert n <= 1.02 * -(-sum(r["length"] for r in rows) // 64) + 1
    # Blocks of ten pieces: several rounds of dealing anew, and still nothing lost.
    monkeypatch.setattr(packing, "BLOCK_PIECES", 10)
    check_packing(packed_rows(packing.pack(df, 64)), texts, library, 64)


def test_packing_edges(spark, library):
    exact = next(t for t in ("a " * n for n in range(1, 200)) if len(library.encode(t, add_special_tokens=False).ids) == 63)
    df = spark.createDataFrame([(None, "null id", None, 1, "", ""), (5, exact, "", 1, "", ""), (5, exact, "", 1, "", ""), (None, None, None, None, None, None)], DOCS)
    got = sorted((r["doc_id"] or -1, r["piece"], r["length"]) for r in packed_rows(packing.pack(df, 64)))
    assert got == sorted([(-1, 0, 1), (-1, 0, 1 + len(library.encode("null id").ids)), (5, 0, 64), (5, 0, 64)])
    assert packed_rows(packing.pack(df.limit(0), 64)) == []
    with pytest.raises(ValueError):
        packing.pack(df, 0)


def test_packed_ids_read_back(spark, library):
    df = spark.createDataFrame([(1, "one text", "", 1, "", ""), (2, "another one", "", 1, "", "")], DOCS)
    (row,) = packing.sequences(packing.pack(df.coalesce(1), 64)).collect()
    want = {(*library.encode("one text").ids, 2, *library.encode("another one").ids, 2), (*library.encode("another one").ids, 2, *library.encode("one text").ids, 2)}
    assert tuple(row["ids"]) in want


# ---- filter audit ----


def brute(rows, labels):
    """The contract's counts, document by document."""
    import re

    docs = []
    for doc_id, text, lang in rows:
        t = text or ""
        w = re.findall("[^ \t\n\x0b\x0c\r]+", t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": doc_id is not None and any(i is not None and i < doc_id and (x or "") == t for i, x, _ in rows),
        }
        good = any(i == doc_id and q == 1 for i, q, _ in labels) if doc_id is not None else False
        toxic = any(i == doc_id and x == 1 for i, _, x in labels) if doc_id is not None else False
        docs.append((lang or "", fails, good, toxic))
    out, shapley = [], {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            alive = list(own)
            for step, f in enumerate(order, 1):
                gone = [d for d in alive if d[1][f]]
                failing = [d for d in own if d[1][f]]
                alive = [d for d in alive if not d[1][f]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                only = sum(all(d[1][g] == (g == f) for g in "ABCDE") for d in own)
                out.append((part, "".join(order), step, f, len(alive), len(gone), len(failing) - len(gone), only, sum(d[2] for d in gone), sum(d[3] for d in gone)))
    return sorted((*r, shapley[r[0], r[3]]) for r in out)


COLUMNS = ["part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, g, 1, "clash", "other") for i, t, g in rows], DOCS)
    judged = filter_audit.judged(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return sorted(tuple(r) for r in filter_audit.audit(judged, list("ABCDE")).select(COLUMNS).collect())


def test_audit_is_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    texts = [None, "", " \n", "A B C", "x# y", "Straße ÄÖÜ €uro", "😀 💡 " * 60, " ".join(words[:150]), " ".join(words[:150]).upper(), " ".join(words[:99]) + " |", "rep " * 500]
    rows = [(rnd.choice([k, None, 3]) if k % 7 == 0 else k, rnd.choice(texts), rnd.choice(["de", "en", None, ""])) for k in range(60)]
    rows += [(70, "same", "de"), (70, "same", "de"), (71, "same", "en"), (72, "same", "de")]
    labels = [(k, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for k in range(0, 72, 2)] + [(4, 1, 1), (None, 1, 1)]
    assert audited(spark, rows, labels) == brute(rows, labels)


def test_audit_edges(spark):
    assert audited(spark, [], []) == []
    one = audited(spark, [(1, None, None)], [])
    assert len(one) == 600 and {r[0] for r in one} == {""}
    with pytest.raises(ValueError):
        filter_audit.audit(spark.createDataFrame([], "part string"), [])


def test_audit_of_two_filters(spark):
    rows = spark.createDataFrame([("p", True, False, 1, 0, 5), ("p", True, True, 0, 1, 2), ("p", False, False, 1, 1, 3)], "part string, X boolean, Y boolean, good int, toxic int, n long")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in filter_audit.audit(rows, ["X", "Y"]).collect()}
    assert got == {("XY", 1): (3, 7, 0, 5, 2, 12), ("XY", 2): (3, 0, 2, 0, 0, 2), ("YX", 1): (8, 2, 0, 0, 2, 2), ("YX", 2): (3, 5, 2, 5, 0, 12)}


# ---- the registered queries on the smallest tables ----

SF = "/root/testdata/sf0.001"


def test_op11_query(spark, library):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{SF}/documents.parquet")
    texts = dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))
    rows = [r.asDict() for r in QUERIES["op11_packing"](spark, SF).collect()]
    n = check_packing(rows, texts, library, 1024)
    assert n <= -(-sum(r["length"] for r in rows) // 1024) + 2


def test_op12_query(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    want = con.sql(ORACLE_SQL["op12_filter_audit"]).project(", ".join(COLUMNS)).fetchall()
    assert sorted(tuple(r) for r in QUERIES["op12_filter_audit"](spark, SF).select(COLUMNS).collect()) == sorted(want)
