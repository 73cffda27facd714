"""Operators against brute force, exact round trips and planted cases, with nulls, empty tables, ties and clashing columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import ann, chat, decontaminate, edit_counts, jaccard, line_dedup, lm_score, mixing, quality, rans, token_output
from gleaner.llm.components import components
from gleaner.llm.mph import PerfectHash
from gleaner.llm.tokens import ChunkTokenizer, tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators name inside are here too.
CLASH = "doc_id long, text string, source string, tie long, size long, shard int, d1 long, n long, target boolean, score double"


def docs_of(spark, texts, schema=DOCS, first=0):
    width = len(schema.split(","))
    rows = [(k + first, t, *["s" if "string" in c else None for c in schema.split(", ")[2:]]) for k, t in enumerate(texts)]
    assert all(len(r) == width for r in rows)
    return spark.createDataFrame(rows, schema)


def words_text(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# ---- token ids and blocks ----


def test_rans_round_trip_and_segments():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 5000, 600_000):
        ids = rng.zipf(1.3, n) % 900
        table = rans.Table.of_counts(np.bincount(ids, minlength=1))
        block = rans.encode(ids, table)
        assert (rans.decode(block, table) == ids).all()
        if n > 1000:
            assert (rans.decode(block, table, n // 3, n // 3 + 50) == ids[n // 3 : n // 3 + 50]).all()
    assert len(block) < 600_000 * 2
    broken = bytearray(block)
    broken[-9] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        rans.decode(bytes(broken), table)
    with pytest.raises(ValueError, match="another table"):
        rans.decode(block, rans.Table.of_counts(np.array([1, 2])))


def test_chunk_tokenizer_is_exact():
    from tokenizers import Tokenizer

    hard = ["it's DON'T we'RE 3.14 x² ª <|endoftext|> a<|startoftext|>b İ ΣΑΣ é tab\there", "", None, "日本語 テスト\r\n", "'s's ``~~ ##$$ a1b2.,", "\x00\x1f\x7f\x85 q\xa0r", "ǅ ß ẞ ŉ ſ ...end. a,b"]
    rng = random.Random(5)
    hard += ["".join(rng.choice("aB é.,'1 \n<ß") for _ in range(80)) for _ in range(200)]
    hard += ["".join(rng.choice(["'", "s", "t", "re", "ve", "m", "ll", "d", "'s", "'re", "!", "1", "²", "ª", "É", "ĸ", " ", "  ", "\n"]) for _ in range(60)) for _ in range(400)]
    own, n = ChunkTokenizer("word_bpe_49k.json", most=50).encode(hard)
    whole = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    expected = [whole.encode(t or "", add_special_tokens=False).ids for t in hard]
    assert n.tolist() == [len(x) for x in expected]
    assert own.tolist() == [i for x in expected for i in x]


def test_token_output(spark):
    from tokenizers import Tokenizer

    texts = ["a b c", None, "", "x " * 3000, "a b c"]
    df = docs_of(spark, texts, CLASH).unionByName(spark.createDataFrame([(None, "no id", "s", 1, 1, 1, 1, 1, True, 0.0), (0, "a b c", "s", 1, 1, 1, 1, 1, True, 0.0)], CLASH))
    path = token_output.write(df, block_tokens=100)
    got = [tuple(r) for r in token_output.read(spark, path, keep_ids=True).orderBy("start").collect()]
    whole, start = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")), 0
    for (d, t), r in zip([(None, "no id"), (0, "a b c"), (0, "a b c"), (1, ""), (2, ""), (3, "x " * 3000), (4, "a b c")], got, strict=True):
        ids = [*whole.encode(t, add_special_tokens=False).ids, 1]
        assert r == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)
    assert token_output.read(spark, token_output.write(docs_of(spark, []))).count() == 0


# ---- quality ----


def test_quality_held_out(spark):
    rng = random.Random(2)
    good = [words_text(rng, 60, 300) for _ in range(300)]
    bad = [words_text(rng, 60, 300).upper().replace(" ", "!! ") for _ in range(150)] + ["same " * 40 for _ in range(50)]
    df = docs_of(spark, good + bad + [None, ""])
    labels = spark.createDataFrame([(k, int(k < 300)) for k in range(500)] + [(None, 1), (3, None)], "doc_id long, quality int")
    out = quality.classify(df, labels.filter(~quality.held_out(F.col("doc_id")))).withColumn("held", quality.held_out(F.col("doc_id"))).collect()
    judged = [r for r in out if r.held and r.doc_id < 500]
    assert len(judged) > 60 and sum(r.predicted == int(r.doc_id < 300) for r in judged) / len(judged) > 0.98
    assert all(0 <= r.score <= 1 for r in out) and len({r.score for r in out if not r.text}) == 1
    empty = quality.classify(df, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in empty] == [0.5]
    assert quality.classify(docs_of(spark, []), labels).count() == 0


def test_quality_by_force():
    """Features by plain loops, and training and scores by an unfolded embed-average-softmax."""
    p = quality.Params(buckets=64, dim=3, epochs=2, bigram_hashes=2)
    full = (1 << 64) - 1
    texts = ["the cat", "cat cat CAT,", None, "", "é x  x\nlong word", " a " * 3, "y" * 5000]

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
        return x ^ (x >> 31)

    def salt(k):
        return (k + 1) * 0x9E3779B97F4A7C15 & full

    def hash_of(word):
        return mix(sum(mix((ord(c) + k * salt(1)) & full) for k, c in enumerate(f"<{word}>")) & full)

    def plain(text):
        words, out = (text or "").split(), []
        for w in words:
            out.append(mix(hash_of(w) ^ salt(2)) % 64)
            m = f"<{w}>"
            for n in (3, 4):
                for k in range(len(m) - n + 1):
                    g = n
                    for c in m[k : k + n]:
                        g = (mix(g) + ord(c)) & full
                    out.append(mix(g) % 64)
        for a, b in zip(words, words[1:], strict=False):
            out += [mix(((hash_of(a) ^ hash_of(b)) + salt(3 + k)) & full) % 64 for k in range(2)]
        return out

    rows = []
    for t, (ids, share) in zip(texts, quality.features(texts, p), strict=True):
        counts = Counter(plain(t))
        assert ids.tolist() == sorted(counts)
        assert share.tolist() == pytest.approx([counts[i] / sum(counts.values()) for i in sorted(counts)])
        rows.append((ids.astype(np.int64), share, len(rows) % 2))
    logits, bias = quality.fit(rows, p)
    # The same descent with one vector for each feature of a document, unfolded.
    rng = np.random.default_rng(p.seed)
    embed, layer, b, done = rng.uniform(-1 / 3, 1 / 3, (64, 3)).astype(np.float32).astype(float), np.zeros((2, 3)), np.zeros(2), 0

    def forward(t):
        own = plain(t)
        mean = sum((embed[i] for i in own), np.zeros(3)) / max(1, len(own))
        z = layer @ mean + b
        return own, mean, np.exp(z) / np.exp(z).sum()

    for _ in range(p.epochs):
        for k in rng.permutation(len(texts)):
            rate = p.rate * (1 - done / (p.epochs * len(texts)))
            done += 1
            own, mean, prob = forward(texts[k])
            error = prob - np.eye(2)[k % 2]
            step = layer.T @ error
            layer -= rate * np.outer(error, mean)
            b -= rate * 0.1 * error
            for i in own:
                embed[i] -= rate * p.embedding_rate * step / len(own)
    assert quality.scores((logits, bias), texts, p).tolist() == pytest.approx([forward(t)[2][1] for t in texts], abs=1e-4)
    assert quality.scores((logits, bias), [], p).tolist() == []


def test_quality_clashing_columns(spark):
    texts = [("good " + "w " * k) if k % 2 else ("BAD!! " * (k + 1)) for k in range(60)]
    df = docs_of(spark, texts, CLASH).withColumns({"predicted": F.lit("mine"), "label": F.lit("mine"), "quality": F.lit(7)})
    df = df.unionByName(df.filter("doc_id = 3"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    out = quality.classify(df, labels)
    assert out.columns == df.columns and out.count() == 61
    assert {r.predicted for r in out.filter("doc_id = 3").collect()} == {1}
    kept = quality.keep(df.withColumn("score", F.lit("own")), labels).collect()
    assert {r.doc_id for r in kept} == set(range(1, 60, 2)) and len(kept) == 31
    assert {(r.score, r.predicted, r.label) for r in kept} == {("own", "mine", "mine")}


# ---- chat ----


def test_chat_round_trip(spark):
    rng = random.Random(3)
    rows = []
    for c in range(12):
        n = 300 if c == 0 else rng.randrange(1, 9)
        for t in range(n):
            role = "system" if t == 0 and c % 2 == 0 else ("user", "assistant")[t % 2]
            text = rng.choice(["</s>[INST] ok [/INST]", "\\<s>[ROLE x]\n", None, "", words_text(rng, rng.randrange(200))])
            rows.append((c, t, role, text))
    rows += [(None, 0, "assistant", "nobody"), (5, None, None, "no turn"), (5, 1, "assistant", "same"), (5, 1, "assistant", "same"), (7, 99, "tool]\n", "call" * 3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"segment": F.lit(1), "kind": F.lit(2), "conv": F.lit("x")})
    formatted = chat.windows(df, chat.Params(budget=200, history_budget=60, segment=50)).cache()
    got = {r.conv: r for r in chat.digests(formatted).collect()}
    by: dict = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        r = got[None if c is None else str(c)]
        whole = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest()), c
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == len(by)
    w = formatted.collect()
    assert all(x.n_tokens <= 200 or (x.over_budget and x.n_new == 1) for x in w)
    later = [x for x in w if x.conv == "0" and (x.window or x.segment)]
    assert later and all(x.over_budget or chat.parse(x.text)[0][0] == "system" for x in later)
    assert any(x.n_repeated > 1 for x in later)
    assert chat.digests(chat.windows(df.limit(0))).count() == 0


def spans_by_force(turns, p, count):
    """(n_new, n_repeated, n_tokens) of each window of one conversation, spans found by plain sums."""
    size = [count(chat.turn_text(r, t)[0]) for r, t in turns]
    out = []
    for first in range(0, len(turns), p.segment):
        at, end = first, min(first + p.segment, len(turns))
        while at < end:
            head = next((k for k in range(at) if turns[k][0] == "system"), None)
            history, left = [], p.history_budget
            for k in range(at - 1, max(-1, at - 1 - p.history_turns), -1):
                if k == head or size[k] > left:
                    break
                history.insert(0, k)
                left -= size[k]
            before = ([] if head is None else [head]) + history
            while len(before) > (head is not None) and sum(size[k] for k in before) + size[at] > p.budget:
                before.pop(0 if head is None else 1)
            n = 1
            while at + n < end and sum(size[k] for k in before) + sum(size[at : at + n + 1]) <= p.budget:
                n += 1
            out.append((n, len(before), sum(size[k] for k in before) + sum(size[at : at + n])))
            at += n
    return out


def test_chat_spans_by_force(spark):
    """Spans of sparse turn numbers, in segments by rank, with history across them; the tokenizer's own strings are escaped."""
    from gleaner.llm.tokens import coder

    rng, p = random.Random(21), chat.Params(budget=120, history_turns=3, history_budget=50, segment=7)
    talks, rows = {}, []
    for c in range(25):
        turns = [(rng.choice(["user", "assistant", "system"] if c % 3 else ["user", "assistant"]), rng.choice(["<|endoftext|>", "<|startoftext|> x <s>", words_text(rng, rng.choice([0, 1, 5, 30, 90, 200]))])) for _ in range(rng.choice([1, 3, 8, 40]))]
        talks[str(c)] = turns
        rows += [(c, 1000 * k * k - 5, r, t) for k, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("conv", "at", "rank", "part", "c", "p", "segment", "first")})
    got: dict = {}
    for w in sorted(chat.windows(df, p).collect(), key=lambda w: (w.segment, w.window)):
        got.setdefault(w.conv, []).append(w)
    own = coder(p.tokenizer)
    for c, turns in talks.items():
        assert [(w.n_new, w.n_repeated, w.n_tokens) for w in got[c]] == spans_by_force(turns, p, lambda t: int(own.encode([t])[1][0])), c
        assert [x for w in got[c] for x in chat.parse(w.text)[w.n_repeated :]] == turns
    whole = "".join(w.text for v in got.values() for w in v)
    assert "<|endoftext|>" not in whole and "<\\|endoftext|>" in whole


# ---- mixing ----


def test_mixing_targets_and_shards(spark):
    rng = random.Random(4)
    rows = [(k, words_text(rng, rng.randrange(0, 60)), rng.choice(["a", "b", "é", None, "z"])) for k in range(600)] + [(None, "x y", "a"), (1, None, "a"), (7, "t t", "b"), (7, "t t", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit(-1), "target": F.lit(0), "shards": F.lit(1), "block": F.lit(2), "n": F.lit(3)})
    got = mixing.plan(df, shards=7).collect()
    again = mixing.plan(df.repartition(3), shards=7).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.tie)
    assert sorted(got, key=key) == sorted(again, key=key)
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    weights = dict(zip(sorted(size, key=lambda s: (s is None, s or "")), (5, 2, 1, 5, 2), strict=True))
    target, left, open_ = {}, 1.5 * sum(size.values()), set(size)
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level >= 2 * size[s]}
        if not full:
            target |= {s: weights[s] * level for s in open_}
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= full
    by = {(d, t): s for d, t, s in rows}
    taken, per = Counter(), Counter()
    texts = {r[0]: r for r in spark.createDataFrame([(t,) for _, t, _ in rows], "text string").distinct().select(F.xxhash64("text"), "text").collect()}
    for r in got:
        s = by[r.doc_id, texts[r.tie][1]]
        taken[s] += r.size * len(r.shards)
        per.update(r.shards)
        assert r.source_size == size[s] and abs(r.target - target[s]) < 1e-6 and len(r.shards) <= 2
    assert all(abs(taken[s] - target[s]) <= 60 for s in size)
    assert set(per) == set(range(7))
    assert mixing.mix(df, shards=7).count() >= sum(len(r.shards) for r in got)
    assert mixing.plan(df.limit(0)).count() == 0


def test_mix_emits_its_plan(spark, monkeypatch):
    """Each row is emitted once for each of its draws, equal id and text in two sources by either's plan; what is taken is
    counted from the rows emitted."""
    rng = random.Random(5)
    rows = [(k, words_text(rng, rng.randrange(0, 40)), rng.choice(["a", "b", None])) for k in range(200)]
    rows += [(k, "same text", s) for k in range(300, 330) for s in ("a", "b", "c")] + [(7, "t t", "b")] * 2 + [(None, "x y", "a"), (1, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, size = Counter(), Counter()
    for r in mixing.plan(df, shards=5).collect():
        for copy, shard in enumerate(r.shards):
            want[r.doc_id, r.source, r.tie, copy, shard] += 1
        size[r.doc_id, r.size, r.source_size, r.size * len(r.shards)] += 1
    mixed = mixing.mix(df, shards=5)
    assert Counter(tuple(r) for r in mixed.select("doc_id", "source", F.xxhash64("text"), "copy", "shard").collect()) == want
    got = mixing.taken(df, shards=5)
    assert Counter(tuple(r) for r in got.select("doc_id", "size", "source_size", "taken").collect()) == size
    mix = mixing.mix
    monkeypatch.setattr(mixing, "mix", lambda *a, **b: mix(*a, **b).filter("doc_id % 2 = 0"))
    assert all(r.taken == 0 for r in mixing.taken(df, shards=5).filter("doc_id % 2 = 1").collect())


def test_mix_keeps_clashing_columns(spark):
    """Columns named as ``mix`` names its own, inside or out, come out as they were; targets are met closely."""
    rng = random.Random(15)
    rows = [(k, words_text(rng, rng.randrange(1, 60)), rng.choice("abc")) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    own = {c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in ("d", "t", "s", "shard", "copy", "tie", "shards", "size", "n", "block", "target", "_source")}
    out = mixing.mix(df.withColumns(own), shards=3)
    assert out.columns == ["doc_id", "text", "source", *own, "mix_shard", "mix_copy"]
    plain = Counter((r.doc_id, r.shard, r.copy) for r in mixing.mix(df, shards=3).collect())
    got = out.collect()
    assert Counter((r.doc_id, r.mix_shard, r.mix_copy) for r in got) == plain
    assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in own)
    totals = mixing.taken(df).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect()
    assert all(abs(r.taken - r.target) <= 0.01 * r.size for r in totals)


def test_hypergeometric_matches_exact_distribution(spark):
    from math import comb

    total, marked, drawn = 60, 25, 20
    us = [(k + 0.5) / 4000 for k in range(4000)]
    df = spark.createDataFrame([(u,) for u in us], "u double")
    got = Counter(r[0] for r in df.select(mixing.hypergeometric(F.lit(total), F.lit(marked), F.lit(drawn), F.col("u"))).collect())
    for h in range(0, 21):
        assert abs(got[h] / 4000 - comb(25, h) * comb(35, 20 - h) / comb(60, 20)) < 1e-3
    q = spark.createDataFrame([("a", 100), ("b", 7), (None, 0), ("c", 41)], "source string, quota long")
    parts = mixing.split_quotas(q, 6).collect()
    for s, n in (("a", 100), ("b", 7), (None, 0), ("c", 41)):
        assert sum(r.n for r in parts if r.source == s) == n
    sizes = Counter()
    for r in parts:
        sizes[r.shard] += r.n
        assert r.n >= 0
    assert max(sizes.values()) - min(sizes.values()) <= 1


# ---- edit-aware counts ----


@pytest.mark.parametrize("leaf", [2, 64])
def test_edits_match_whole_encoding(monkeypatch, leaf):
    from tokenizers import Tokenizer

    monkeypatch.setattr(edit_counts, "LEAF", leaf)
    whole = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    rng, counter, alphabet = random.Random(6), edit_counts.PieceCounter(), "ab c  é1.'s\n\t ñ日 !!"
    for _ in range(60):
        x = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 3, 20, 200, 3000])))
        tree = edit_counts.TokenTree(x, counter)
        planted = tree.encoded
        for _ in range(6):
            p, d = rng.randint(0, len(x) + 3), rng.choice([0, 0, 1, 3, 50])
            ins = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 9, 300])))
            x = x[: min(p, len(x))] + ins + x[min(p, len(x)) + d :]
            tree.edit(p, d, ins)
            assert tree.text() == x
            assert tree.tokens == len(whole.encode(x, add_special_tokens=False).ids)
        if len(x) > 3000:
            assert tree.encoded - planted < planted + 2000


def test_edit_count_rows(spark):
    df = docs_of(spark, ["hello big world", None, "", "untouched"], CLASH)
    edits = spark.createDataFrame([(0, 1, 6, 4, ""), (0, 2, 0, 0, "Oh, "), (2, 1, 5, 9, "new"), (1, 1, None, None, None)], "doc_id long, edit_no int, pos long, n_delete long, insert string")
    got = {r.doc_id: r for r in edit_counts.count(edit_counts.with_edits(df, edits)).collect()}
    counter = edit_counts.PieceCounter()
    n = lambda t: edit_counts.TokenTree(t, counter).tokens
    assert [(got[k].n_tokens, got[k].n_tokens_edited) for k in range(4)] == [(n("hello big world"), n("Oh, hello world")), (0, 0), (0, n("new")), (n("untouched"),) * 2]
    assert got[3].n_reencoded == 0
    assert edit_counts.count(edit_counts.with_edits(df.limit(0), edits)).count() == 0


def test_stored_trees_take_batches_of_edits(spark, tmp_path):
    """Two batches on stored trees give the counts of the whole texts and encode only what they touch."""
    from tokenizers import Tokenizer

    rng = random.Random(31)
    texts = [words_text(rng, 3000), "a <|endoftext|> b", None, "", words_text(rng, 50)]
    df = docs_of(spark, texts, CLASH).unionByName(docs_of(spark, ["no id"], CLASH).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs_of(spark, [texts[4]], CLASH, 4))
    edit_counts.plant(df).write.parquet(f"{tmp_path}/0")
    whole = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    now = {k: t or "" for k, t in enumerate(texts)}
    for batch in range(2):
        rows = []
        for k, e in ((0, 0), (0, 1), (1, 0), (4, 0)):
            pos, cut, more = rng.randrange(len(now[k]) + 1), rng.randrange(9), rng.choice(["", " new words", "é1"])
            rows.append((k, e, pos, cut, more))
            now[k] = now[k][:pos] + more + now[k][pos + cut :]
        edits = spark.createDataFrame(rows, "doc_id long, edit_no int, pos long, n_delete long, insert string")
        edit_counts.edit(spark.read.parquet(f"{tmp_path}/{batch}"), edits).write.parquet(f"{tmp_path}/{batch + 1}")
        got = spark.read.parquet(f"{tmp_path}/{batch + 1}").collect()
        assert Counter(r.doc_id for r in got) == Counter(["0", "1", "2", "3", "4", "4", None])
        for r in got:
            own = now[int(r.doc_id)] if r.doc_id else "no id"
            assert (r.text, r.n_tokens) == (own, len(whole.encode(own, add_special_tokens=False).ids))
            assert r.n_encoded < 600 and (r.n_encoded > 0) == (r.doc_id in ("0", "1", "4"))


# ---- lines ----


def lines_by_force(rows, min_docs=3):
    strip = " \t\n\x0b\x0c\r"
    held: dict = {}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for d, t in rows:
        for k in {x.strip(strip).translate(low) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                held.setdefault(k, []).append(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = []
        for x in lines:
            own = held.get(x.strip(strip).translate(low), [])
            top = max((y for y in own if y is not None), default=None)
            if len(own) < min_docs or d == top:
                keep.append(x)
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("resident", [1 << 30, 0])
def test_line_dedup(spark, resident):
    rng = random.Random(7)
    pool = [f"A shared line of number {k} É " for k in range(12)] + ["short", "", "  \tpadded shared line number one \r", "PADDED shared line number ONE"]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for k in range(60)]
    rows += [(100, None), (101, ""), (None, pool[0]), (59, pool[0] + "\n" + pool[0]), (102, "y" * 100_000)]
    # The least of all ids isn't the null one, which is below it; 0 isn't either.
    least, nobody, both = -(1 << 63), "a line that only null ids hold", "a line of the least id and of null ids"
    rows += [(None, nobody + "\n" + both)] * 3 + [(least, both), (least, pool[1]), (None, "held by null and nought, often\n" + both), (0, "held by null and nought, often")]
    rows += [(None, "held by null and nought, often")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit("a"), "h1": F.lit("b"), "tie": F.lit("c"), "no_id": F.lit("d")})
    got = sorted((tuple(r) for r in line_dedup.dedup(df, resident_bytes=resident).collect()), key=repr)
    assert got == lines_by_force(rows)
    assert line_dedup.dedup(df.limit(0), resident_bytes=resident).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        own = PerfectHash.build(keys)
        assert sorted(own(keys)) == list(range(len(keys)))
        again, size = PerfectHash.load(own.dump())
        assert (again(keys) == own(keys)).all() and size == len(own.dump())
    assert size * 8 < 5 * len(keys)
    with pytest.raises(ValueError, match="distinct"):
        PerfectHash.build(np.array([3, 3], np.uint64))


def test_line_index_with_shared_bits(spark):
    """Keys that share the 64 bits that are hashed get a hash of all bits."""
    h1, h2 = np.array([5, 5, 9, 5], np.uint64), np.array([1, 2, 1, 3], np.uint64)
    counted = spark.createDataFrame([(int(a), int(b), 3 + k, 10 + k) for k, (a, b) in enumerate(zip(h1, h2, strict=True))], "h1 long, h2 long, n_docs long, keeper long")
    table, shards = line_dedup.build_index(counted)
    index = line_dedup.LineIndex(bytes(table.head().data))
    assert shards == 1 and [x.tolist() for x in index.probe(h1, h2)] == [[3, 4, 5, 6], [10, 11, 12, 13], [False] * 4]
    assert index.probe(np.array([5, 9], np.uint64), np.array([4, 2], np.uint64))[0].tolist() == [0, 0]


# ---- similarity ----


def groups_by_force(rows, width, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and None not in (rows[i][0], rows[j][0]) and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least: dict = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return sorted(((d, len(sets[k]), least.get(find(k))) for k, (d, _) in enumerate(rows)), key=repr)


def test_jaccard_groups(spark):
    rng = random.Random(9)
    base = [words_text(rng, n, 400) for n in (3, 40, 80, 120)]
    rows = []
    for k in range(120):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = f"v{rng.randrange(999)}"
        rows.append((1000 - k, " ".join(w).upper() if k % 7 == 0 else "\t ".join(w)))
    rows += [(1, None), (2, ""), (3, " \n"), (None, base[1]), (4, "one two"), (5, "ONE two"), (6, words_text(rng, 30_000, 5000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"d1": F.lit("a"), "n": F.lit("b"), "u": F.lit(1), "component": F.lit(2)})
    for width, percent in ((4, 85), (5, 80), (3, 60)):
        got = sorted((tuple(r) for r in jaccard.groups(df, jaccard.Similarity(width, percent)).collect()), key=repr)
        assert got == groups_by_force(rows, width, percent)
    kept = {r.doc_id for r in jaccard.keep_one(df, jaccard.Similarity(5, 80)).collect()}
    assert kept == {d for d, _, c in groups_by_force(rows, 5, 80) if d == c} | {None}
    assert jaccard.groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("part", [400, 3])
def test_jaccard_join_gives_every_link(spark, monkeypatch, part):
    """All pairs of classes by force, with hot buckets in blocks and bands of length."""
    monkeypatch.setattr(jaccard, "PART", part)
    rng = random.Random(19)
    boiler = words_text(rng, 30, 400)
    rows = [(k, boiler + " " + words_text(rng, rng.choice([0, 1, 2, 4, 7]), 400)) for k in range(60)]
    rows += [(100 + k, words_text(rng, rng.choice([2, 3, 20]), 6)) for k in range(30)] + [(300, None), (301, ""), (None, boiler)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("band", "g", "key", "to", "own")})
    for width, percent in ((4, 85), (3, 60), (2, 100)):
        sets: dict = {}
        for d, t in rows:
            w = (t or "").split()
            if w and d is not None:
                sets.setdefault(frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))), []).append(d)
        want = {tuple(sorted((min(sets[x]), min(sets[y])))) for x in sets for y in sets if x is not y and 100 * len(x & y) >= percent * len(x | y)}
        pairs, members = jaccard.join(df, jaccard.Similarity(width, percent))
        got = [tuple(r) for r in pairs.collect()]
        assert len(got) == len(set(got)) and set(got) == want
        classes = {d: (len(x), min(own), sum(min(own) in p for p in want)) for x, own in sets.items() for d in own}
        assert {r.doc_id: tuple(r)[1:] for r in members.collect()} == classes | {300: (0, None, 0), 301: (0, None, 0)}
    grouped = sorted((tuple(r) for r in jaccard.groups(df, jaccard.Similarity(3, 60)).collect()), key=repr)
    assert grouped == groups_by_force(rows, 3, 60)


def test_keep_one_with_repeated_ids(spark):
    rng = random.Random(10)
    a, b, c, d, e = (words_text(rng, 60, 4000) for _ in range(5))
    rows = [(1, a, "x"), (1, a, "x"), (1, a, "y"), (5, a + " end", "x"), (5, b, "x"), (7, c, "x"), (7, c + " end", "x"), (3, d, "x"), (9, d + " end", "x"), (3, e, "x"), (8, e + " end", "x"), (None, a, "x"), (4, "", "x"), (4, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r.doc_id, r.text.removesuffix(" end")) for r in jaccard.keep_one(df, jaccard.Similarity(5, 80)).collect()]
    assert Counter(got) == Counter([(1, a), (5, b), (7, c), (3, d), (3, e), (None, a), (4, ""), (4, "")])


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 102), (102, 101), (7, 7), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- language model ----


@pytest.mark.parametrize(("resident", "leave_out"), [(1 << 30, True), (40, True), (5, False), (1 << 30, False)])
def test_lm_scores(spark, resident, leave_out):
    """Against plain counts of all texts, less those of the text itself."""
    import math

    from tokenizers import Tokenizer

    rng = random.Random(18)
    texts = ["the cat sat", "the cat ran", None, "", "a dog sat on the cat", "THE cat sat", "the cat sat", "the the the the cat", words_text(rng, 30_000, 900)]
    df = docs_of(spark, texts, CLASH).unionByName(docs_of(spark, texts[:1], CLASH)).drop("target")
    texts, marks = texts + texts[:1], [k < 2 or k == 8 for k in range(len(texts))] + [True]
    marked = df.withColumn("target", F.col("doc_id").isin(0, 1, 8))
    counts = lm_score.count_bigrams(marked)
    out = lm_score.score(marked, counts, resident=resident, leave_out=leave_out).collect()
    whole = Tokenizer.from_file(tokenizer_file(lm_score.TOKENIZER))
    start, stop, span = lm_score.ends()
    assert (start, stop, span) == (49_408, 49_409, 49_410)
    ids = [[start, *whole.encode(t or "", add_special_tokens=False).ids, stop] for t in texts]
    bigrams = [Counter(zip(x, x[1:], strict=False)) for x in ids]

    def mean_loss(own, counted, out):
        """The loss of a text whose own bigrams are left out if it is among the counted."""
        every = sum((bigrams[k] for k in counted), Counter())
        kinds = Counter(h for h, _ in every)
        left = every - own if out else every
        word, context = Counter(), Counter()
        for (h, w), n in left.items():
            word[w] += n
            context[h] += n
        total, loss = sum(left.values()), 0.0
        for (h, w), n in own.items():
            p = (word[w] + 1) / (total + span)
            loss -= n * math.log((left[h, w] + kinds[h] * p) / (context[h] + kinds[h]) if kinds[h] else p)
        return loss / sum(own.values())

    got: dict = {}
    for r in out:
        got.setdefault(r.doc_id, []).append(r)
    assert len(out) == len(texts)
    for k, own in enumerate(bigrams):
        t = mean_loss(own, [j for j, m in enumerate(marks) if m], marks[k] and leave_out)
        b = mean_loss(own, range(len(texts)), leave_out)
        for r in got[k % 9]:
            assert (r.n_tokens, r.target_loss, r.background_loss, r.score) == (sum(own.values()), pytest.approx(t, abs=1e-9), pytest.approx(b, abs=1e-9), pytest.approx(t - b, abs=1e-9))
    assert got[0][0].score < got[4][0].score
    empty = df.limit(0)
    assert lm_score.cross_entropy_difference(empty, empty).count() == 0
    by_id = {r.doc_id: r.score for r in lm_score.cross_entropy_difference(df, marked.filter("target")).collect()}
    assert leave_out is False or by_id[4] == pytest.approx(got[4][0].score)


# ---- nearest neighbours ----


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(3000, 16)).astype(np.float32) * rng.uniform(0.5, 2, (3000, 1)).astype(np.float32) + (np.arange(3000) % 6)[:, None].astype(np.float32)
    x[100:400] = x[100]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    bad = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0] * 3), (5004, [None] + [1.0] * 15), (None, [1.0] * 16), (5005, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumns({"leaf": F.lit("a"), "bucket": F.lit(1), "score": F.lit(2)})
    got = ann.search(df, df.filter("vec_id % 20 = 0"), ann.Params(leaf=64, bucket=500, recall=0.95)).collect()
    by: dict = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by) == set(range(0, 3000, 20))
    y, ids, found = x.astype(np.float64), np.arange(3000), []
    for q, hits in by.items():
        s = (y * y[q]).sum(1)
        s[q] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        assert [v for _, v in hits] == [s[i] for i, _ in hits] and len(hits) == 20
        found.append(len({i for i, _ in hits} & set(best.tolist())) / 20)
    assert np.mean(found) >= 0.9
    few = ann.search(df.filter("vec_id < 5"), df.filter("vec_id = 0")).collect()
    assert len(few) == 4
    assert ann.search(df.limit(0), df).count() == 0
    for hits in by.values():
        assert hits == sorted(hits, key=lambda h: (-h[1], h[0]))


def test_nearest_widens_and_keeps_precision(spark):
    """Doubles stay doubles, queries of another length take no part, one visit widens until k are seen, recall is that of
    other queries."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(900, 9))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    own = ann.Index(df, ann.Params(leaf=4, bucket=100, k=20, calibrate=40))
    assert own.recall >= 0.93 and own.visits > 1
    own.visits = 1
    queries = df.filter("vec_id < 50").unionByName(spark.createDataFrame([(7000, [1.0] * 3), (7001, [1.0] * 9)], df.schema))
    by: dict = {}
    for r in own.search(queries).collect():
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {*range(50), 7001} and all(len(v) == 20 for v in by.values())
    assert all(r.score == (x[r.vec_id] * x[q]).sum() for q, v in by.items() if q < 50 for r in v)
    clustered = rng.normal(size=(40, 8))[np.arange(4000) % 40] * 9 + rng.normal(size=(4000, 8)) * 0.1
    many = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(clustered)], "vec_id long, embedding array<double>")
    index = ann.Index(many, ann.Params(leaf=50))
    assert index.visits < index.tree.value.leaves / 2 and index.recall >= 0.93


# ---- decontamination ----


def test_decontamination(spark, monkeypatch):
    rng = random.Random(11)
    items = [(k, words_text(rng, rng.choice([1, 5, 13, 14, 30]), 4000 if k else 3)) for k in range(30)] + [(3, words_text(rng, 20, 4000)), (90, None), (91, "..."), (None, words_text(rng, 15, 4000))]
    rows = []
    for k in range(80):
        w = words_text(rng, rng.randrange(0, 300), 4000).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            own = (rng.choice(items)[1] or "").split()
            at = rng.randrange(len(w) + 1)
            w[at:at] = own[rng.randrange(len(own) // 2 + 1) :]
        rows.append((k, rng.choice([" ", ", ", "\n"]).join(w).upper()))
    rows += [(200, None), (201, ""), (None, items[5][1]), (5, rows[5][1])]

    def words(t):
        import re

        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))

    windows: dict = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    expected = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        names = sorted(str(i) for i in found if i is not None)
        expected.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"hits": F.lit(1), "no_id": F.lit(2)})
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1_000_000, 60):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        got = [tuple(r) for r in decontaminate.search(df, bench).collect()]
        assert sorted(got, key=repr) == sorted(expected, key=repr)
    bad = [(d, t) for (d, t), e in zip(rows, expected, strict=True) if e[5]]
    assert bad and decontaminate.clean(df, bench).count() == len(rows) - len(bad)
    assert decontaminate.search(df.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.search(df, bench.limit(0)).collect())
    whole = decontaminate.build_index(df)
    assert sorted((tuple(r) for r in decontaminate.search(df, bench, index=whole).collect()), key=repr) == sorted(expected, key=repr)
    assert decontaminate.near(df, bench.limit(0), 20, index=whole).count() == 0


@pytest.mark.parametrize("candidates", [2_000_000, 3])
def test_near_by_force(spark, monkeypatch, candidates):
    """Proximity by trying every stretch; phrases with few candidates at once; very long texts; repeated words."""
    monkeypatch.setattr(decontaminate, "CANDIDATES", candidates)
    monkeypatch.setattr(decontaminate, "SHARD_CHARS", 3000)
    rng = random.Random(14)
    items = [(k, words_text(rng, rng.choice([1, 2, 4, 6]), 25)) for k in range(12)] + [(None, "w1 w2"), (5, "w3 w3 w3 w4")]
    rows = [(k, words_text(rng, rng.randrange(0, 60), 25)) for k in range(40)] + [(100, words_text(rng, 4000, 25)), (None, "w1 w2"), (3, "w3 w4"), (101, None)]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    span, size = 6, 4
    want, exact = Counter(), Counter()
    windows: dict = {}
    for i, t in items:
        w = t.split()
        for k in range(max(1, len(w) - size + 1)):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    for r, (d, t) in enumerate(rows):
        w = (t or "").split()
        for own, held in windows.items():
            if any(set(own) <= set(w[k : k + span]) for k in range(max(1, len(w) - span + 1))):
                for i in held - {None}:
                    want[r, d, str(i)] += 1
            exact.update((r, d, str(i)) for k in range(len(w) - len(own) + 1) if tuple(w[k : k + len(own)]) == own for i in held - {None})
    got = decontaminate.near(df, bench, span, window=size).collect()
    assert Counter((r.doc_id, r.item_id, r.n_near) for r in got) == Counter((d, i, n) for (_, d, i), n in want.items())
    found = decontaminate.search(df, bench, window=size).collect()
    assert Counter((r.doc_id, r.n_items) for r in found) == Counter((d, len({i for q, _, i in exact if q == r})) for r, (d, _) in enumerate(rows))


# ---- pipeline ----


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    item = words_text(rng, 30, 5000)
    texts = [words_text(rng, 80, 900) for _ in range(200)]
    texts += [texts[0], texts[1] + " more", item + " " + texts[2], texts[3].upper().replace(" ", "!! ")] + [words_text(rng, 50, 900).upper().replace(" ", "!! ") for _ in range(60)]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 203), 0) for k in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r.doc_id for r in docs.collect()})
    assert seen[0] == set(range(203)), name
    assert seen[1] == set(range(203)) - {200, 201}
    assert seen[2] == seen[1] - {202}
    mixed = corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).cache()
    assert mixed.columns == docs.columns and 1.4 < mixed.count() / docs.count() < 1.6
    assert corpus_pipeline.encode_tokens(spark, mixed, str(tmp_path)).count() == mixed.count()
