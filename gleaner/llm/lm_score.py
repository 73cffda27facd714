"""Language-model scoring by cross-entropy difference of matched bigram models.

A target and a background model share one vocabulary (a public tokenizer's ids), one order and one smoothing: Witten-Bell
interpolation of bigrams with add-one unigrams.  The background counts every document, the target those marked so; a
text's score is its mean loss per token under the target less that under the background, so lower is nearer the target.
A text's own counts are left out of the models that score it, else every text, those of the target above all, would look
near to what it was counted in; a bigram's context keeps its number of kinds, which is the weight of the unigrams.

``count_bigrams`` sums exact counts over whole texts, pre-summed in each task, into a written table that grows with the
corpus; ``vocabulary`` sums them by id, one row for each.  ``score`` tokenizes each text once.  Bigrams are looked up in
sorted arrays while the table has at most ``RESIDENT`` rows; beyond, the commonest stay in the arrays and each text's counts
of the others are joined to the table by a shuffle, in which no key is common.

Edge cases: a null or empty text is one end-of-text token; a text of any length is scored whole; without target documents the
target is its uniform prior; null and repeated ids are rows of their own (equal rows are scored alike); an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import chunks, small, written
from gleaner.llm.tokens import coder

TOKENIZER = "word_bpe_49k.json"
RESIDENT, FLUSH, TEXT_CHARS = 4_000_000, 2_000_000, 2_000_000
SMALL_LABELS = 2_000_000
KINDS = ("target", "background")


def ends(tokenizer: str = TOKENIZER) -> tuple[int, int, int]:
    """The ids before the first and after the last token, and how many ids there are with them."""
    size = coder(tokenizer).size
    return size, size + 1, size + 2


def _codes(texts: list[str | None], tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """The bigram codes of all texts, and how many each has (its tokens and the end)."""
    start, stop, span = ends(tokenizer)
    ids, n = coder(tokenizer).encode(texts)
    bounds = np.cumsum(n)
    ids = np.insert(ids.astype(np.int64), np.stack([bounds - n, bounds], axis=1).ravel(), np.tile([start, stop], len(n)))
    first = np.ones(len(ids), bool)
    first[np.cumsum(n + 2) - 1] = False  # no bigram begins at an end
    at = np.flatnonzero(first)
    return ids[at] * span + ids[at + 1], n + 1


def _merge(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    back, target = (np.bincount(inv, np.concatenate([p[k] for p in parts]), len(codes)).astype(np.int64) for k in (1, 2))
    return codes, back, target


def _count(tokenizer: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[tuple] = []
        for pdf in batches:
            for rows in chunks(zip(pdf["text"], pdf["target"], strict=True), lambda r: len(r[0] or "") + 1, TEXT_CHARS):
                codes, n = _codes([t for t, _ in rows], tokenizer)
                wanted = np.repeat(np.array([bool(x) for _, x in rows]), n)
                parts = [_merge([*parts, (codes, np.ones(len(codes)), wanted.astype(np.float64))])]
                if len(parts[0][0]) > FLUSH:
                    yield pd.DataFrame(dict(zip(("code", "background", "target"), parts.pop(), strict=True)))
        coder(tokenizer).rest()
        if parts:
            yield pd.DataFrame(dict(zip(("code", "background", "target"), parts.pop(), strict=True)))

    return run


def count_bigrams(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """code, background and target counts over ``docs`` (text, target)."""
    counts = docs.select("text", "target").mapInPandas(_count(tokenizer), "code long, background long, target long")
    return written(counts.groupBy("code").agg(F.sum("background").alias("background"), F.sum("target").alias("target")), "bigrams")


def vocabulary(counts: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """k (an id) and, for either model, its count as a word, as a context, and the context's kinds of next words."""
    span = ends(tokenizer)[2]
    rows = counts.withColumns({"h": F.floor(F.col("code") / span), "w": F.col("code") % span})
    word = rows.groupBy(F.col("w").alias("k")).agg(*[F.sum(x).alias(f"{x}_word") for x in KINDS])
    context = rows.groupBy(F.col("h").alias("k")).agg(*[F.sum(x).alias(f"{x}_n") for x in KINDS], *[F.count_if(F.col(x) > 0).alias(f"{x}_kinds") for x in KINDS])
    return written(word.join(context, "k", "full").na.fill(0), "vocabulary")


def _losses(count, n, kinds, word, total, span: int, own: dict, log, pick):
    """-ln of a bigram's probability from the model's sums less the text's ``own``; the same for arrays and columns."""
    p = (word - own["w"] + 1) / (total - own["n"] + span)
    left = n - own["h"]
    return -log(pick(left + kinds > 0, (count - own["count"] + kinds * p) / (left + kinds), p))


_PARTS = "row long, doc_id string, n_tokens long, target_sum double, background_sum double, code long, n int, own_h int, own_w int, own_n long, target boolean"
_NAMES = [c.split()[0] for c in _PARTS.split(", ")]


def _divided(left: np.ndarray, a: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.where(left, a, p)


def _score(shared, tokenizer: str, rest: bool, leave_out: bool):
    """A row for each text with the sums over bigrams in the arrays, and with ``rest`` one for each other bigram of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, counts, vocab, totals = shared.value
        span = ends(tokenizer)[2]
        for pdf in batches:
            for rows in chunks(zip(pdf["row"], pdf["doc_id"], pdf["target"], pdf["text"], strict=True), lambda r: len(r[3] or "") + 1, TEXT_CHARS):
                codes, size = _codes([t for *_, t in rows], tokenizer)
                doc = np.repeat(np.arange(len(rows)), size)
                pairs, count = np.unique(doc * (span * span) + codes, return_counts=True)
                doc, code = np.divmod(pairs, span * span)
                h, w = np.divmod(code, span)
                # A text's bigrams come by their first word; its words need an order of their own.
                begins = np.flatnonzero(np.diff(doc * span + h, prepend=-1))
                own_h = np.repeat(np.add.reduceat(count, begins), np.diff(begins, append=len(h)))
                _, word = np.unique(doc * span + w, return_inverse=True)
                own_w = np.bincount(word, count)[word]
                at = np.minimum(np.searchsorted(known, code), max(0, len(known) - 1))
                hit = known[at] == code if len(known) else np.zeros(len(code), bool)
                marked = np.array([bool(x) for _, _, x, _ in rows])
                out = {"row": [r[0] for r in rows], "doc_id": [r[1] for r in rows], "n_tokens": size, "target": marked}
                with np.errstate(divide="ignore", invalid="ignore"):
                    for k in KINDS:
                        flag = (marked[doc] if k == "target" else 1) * leave_out
                        own = {"count": count * flag, "h": own_h * flag, "w": own_w * flag, "n": size[doc] * flag}
                        counted = np.where(hit, counts[k][at], 0) if len(known) else np.zeros(len(code))
                        loss = _losses(counted, vocab[f"{k}_n"][h], vocab[f"{k}_kinds"][h], vocab[f"{k}_word"][w], totals[k], span, own, np.log, _divided)
                        out[f"{k}_sum"] = np.bincount(doc, np.where(hit | (not rest), loss * count, 0.0), len(rows))
                yield pd.DataFrame(out | {c: pd.Series([None] * len(rows), dtype="Int64") for c in ("code", "n", "own_h", "own_w", "own_n")})[_NAMES]
                if rest:
                    o = np.flatnonzero(~hit)
                    number = np.array(out["row"], np.int64)[doc[o]]
                    none = {"doc_id": None, "n_tokens": pd.Series([None] * len(o), dtype="Int64"), "target_sum": np.nan, "background_sum": np.nan}
                    yield pd.DataFrame({"row": number, "code": code[o], "n": count[o], "own_h": own_h[o], "own_w": own_w[o].astype(np.int64), "own_n": size[doc[o]], "target": marked[doc[o]]} | none)[_NAMES]
        coder(tokenizer).rest()

    return run


def _array(frame: pd.DataFrame, column: str, span: int) -> np.ndarray:
    out = np.zeros(span, np.int64)
    out[frame["k"].to_numpy(np.int64)] = frame[column].to_numpy(np.int64)
    return out


def score(docs: DataFrame, counts: DataFrame, tokenizer: str = TOKENIZER, resident: int = RESIDENT, leave_out: bool = True) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (per token) and score, their difference, of every row of ``docs``
    (doc_id, text, target); ``counts`` is the result of ``count_bigrams``, over these texts if they are to be left out."""
    spark, span = docs.sparkSession, ends(tokenizer)[2]
    vocab = vocabulary(counts, tokenizer)
    table = vocab.toPandas()  # at most a row for each id
    arrays = {c: _array(table, c, span) for c in table.columns if c != "k"}
    totals = {k: int(arrays[f"{k}_word"].sum()) for k in KINDS}
    n = counts.count()
    rest, common = None, counts
    if n > resident:
        # The commonest stay; the bound may be missed by a thousandth of the table, which has at most span * span rows.
        often = counts.approxQuantile("background", [1 - resident / n], 0.001)[0]
        common, rest = counts.filter(F.col("background") > often), counts.filter(F.col("background") <= often)
    own = common.toPandas().sort_values("code")
    shared = spark.sparkContext.broadcast((own["code"].to_numpy(np.int64), {k: own[k].to_numpy(np.int64) for k in KINDS}, arrays, totals))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("doc_id"), "target", "text")
    parts = rows.mapInPandas(_score(shared, tokenizer, rest is not None, leave_out), _PARTS)
    if rest is not None:
        parts = written(parts, "parts-of-texts")
        parts = _with_rest(parts, rest, vocab, totals, span, leave_out)
    t, b = F.col("target_sum") / F.col("n_tokens"), F.col("background_sum") / F.col("n_tokens")
    return parts.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType), "n_tokens", t.alias("target_loss"), b.alias("background_loss"), (t - b).alias("score"))


def _with_rest(parts: DataFrame, rest: DataFrame, vocab: DataFrame, totals: dict[str, int], span: int, leave_out: bool) -> DataFrame:
    """The texts' rows with the losses of their other bigrams added to their sums."""
    others = parts.filter("code IS NOT NULL").select("row", "code", "n", "own_h", "own_w", "own_n", "target").join(rest.withColumnsRenamed({k: f"{k}_count" for k in KINDS}), "code", "left")
    # A row for each id of the vocabulary goes to every executor.
    words = F.broadcast(vocab.select(F.col("k").alias("w"), *[f"{k}_word" for k in KINDS]))
    contexts = F.broadcast(vocab.select(F.col("k").alias("h"), *[f"{k}_{x}" for k in KINDS for x in ("n", "kinds")]))
    others = others.withColumns({"h": F.floor(F.col("code") / span), "w": F.col("code") % span}).join(words, "w", "left").join(contexts, "h", "left")

    def loss(k: str) -> Column:
        flag = F.lit(0) if not leave_out else F.lit(1) if k == "background" else F.col("target").cast("int")
        own = {"count": F.col("n") * flag, "h": F.col("own_h") * flag, "w": F.col("own_w") * flag, "n": F.col("own_n") * flag}
        count, n, kinds, word = (F.coalesce(F.col(f"{k}_{x}"), F.lit(0)) for x in ("count", "n", "kinds", "word"))
        return _losses(count, n, kinds, word, F.lit(totals[k]), span, own, F.ln, lambda c, a, p: F.when(c, a).otherwise(p)) * F.col("n")

    summed = others.groupBy(F.col("row").alias("r")).agg(*[F.sum(loss(k)).alias(f"{k}_rest") for k in KINDS])
    whole = parts.filter("code IS NULL").join(summed, F.col("row") == F.col("r"), "left")
    return whole.withColumns({f"{k}_sum": F.col(f"{k}_sum") + F.coalesce(f"{k}_rest", F.lit(0.0)) for k in KINDS})


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Scores ``docs`` (doc_id, text) by models of all of them and of those whose doc_id is in ``targets``."""
    wanted = small(targets.select("doc_id").distinct().withColumn("target", F.lit(True)), SMALL_LABELS)
    marked = docs.select("doc_id", "text").join(wanted, "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    return score(marked, count_bigrams(marked, tokenizer), tokenizer)
