"""Quality classifier: supervised subword embeddings, averaged per document, with a softmax output.

A document's features are its white-space-parted words, their character n-grams (with word borders) and its word bigrams,
each hashed to vectors among ``buckets``.  A bigram's hash is that of its words' hashes combined by exclusive or, so the
bigrams of a word with itself are one feature whatever the word; a bigram has ``bigram_hashes`` vectors.  The mean of all,
weighted by count, goes through a linear softmax layer; vectors and layer are learnt together by numpy stochastic gradient
descent.  As mean and layer are linear, the fitted model folds into one number per bucket (the difference of the two
logits); scoring hashes a batch's distinct words at once over arrays of characters, in one pass without a shuffle.

Fitting takes a bounded sample of labelled documents (``Params.max_train_docs``, chosen by hash); scoring reads whole
texts of all documents.  Case and punctuation stay: they tell much about quality.  ``lang``, ``source``, ``doc_id`` and
the labels are no inputs of a score.

Edge cases: a null or empty text has no features and scores the learnt base rate; a text of any length is scored whole;
without labelled rows every score is 0.5; rows with a null quality or doc_id aren't learnt from; several labels of one
document are averaged, ties are good; of several texts of one doc_id the smallest is learnt from, and each is scored.
``classify`` puts its ``score`` and ``predicted`` in the place of columns of these names; ``keep`` leaves all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import chunks, mix64

#: Characters that are scored at once.
TEXT_CHARS = 2_000_000


@dataclass(frozen=True)
class Params:
    #: A power of two, at most 65,536.
    buckets: int = 1 << 15
    dim: int = 16
    min_n: int = 3
    max_n: int = 4
    bigram_hashes: int = 2
    epochs: int = 6
    rate: float = 0.5
    #: The step of embeddings, in units of ``rate``; their gradient is spread over all features of a document.
    embedding_rate: float = 40.0
    max_train_docs: int = 4000
    seed: int = 7
    threshold: float = 0.3


def _salt(k: int) -> np.uint64:
    return np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def word_features(words: list[str], p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all words and their character n-grams, the number of the word of each, and the words' 64-bit hashes.

    An empty word has no features."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    marked = np.where(sizes > 0, sizes + 2, 0)
    code = np.frombuffer("".join(f"<{w}>" for w in words if w).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), marked)
    ends = np.cumsum(marked)
    place = np.arange(len(code)) - (ends - marked)[owner]
    left = marked[owner] - place  # characters from here to the word's end
    hashes = np.zeros(len(words), np.uint64)
    full = sizes > 0
    if full.any():
        hashes[full] = mix64(np.add.reduceat(mix64(code + place.astype(np.uint64) * _salt(1)), (ends - marked)[full]))
    mask = np.uint64(p.buckets - 1)
    buckets, owners = [mix64(hashes[full] ^ _salt(2)) & mask], [np.flatnonzero(full)]
    for n in range(p.min_n, p.max_n + 1):
        at = np.flatnonzero(left >= n)
        gram = np.full(len(at), n, np.uint64)
        for i in range(n):
            gram = mix64(gram) + code[at + i]
        buckets.append(mix64(gram) & mask)
        owners.append(owner[at])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners), hashes


def bigram_buckets(first: np.ndarray, second: np.ndarray, k: int, p: Params) -> np.ndarray:
    """The ``k``-th bucket of each bigram of words with these hashes."""
    return (mix64((first ^ second) + _salt(3 + k)) & np.uint64(p.buckets - 1)).astype(np.int64)


class _Words:
    """The words of a batch of texts: ``distinct`` ones, each token's among them, and each token's text."""

    def __init__(self, texts: list[str | None]):
        parts = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pa.array([t or "" for t in texts], pa.large_string())))
        coded = parts.flatten().dictionary_encode()
        self.distinct, self.own = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self.text = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy())
        #: The tokens that follow another of the same text.
        self.after = np.flatnonzero(self.text[1:] == self.text[:-1]) + 1


def features(texts: list[str | None], p: Params) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their shares."""
    w = _Words(texts)
    buckets, owner, hashes = word_features(w.distinct, p)
    order = np.argsort(owner, kind="stable")
    buckets, starts = buckets[order], np.searchsorted(owner[order], np.arange(len(w.distinct) + 1))
    bounds = np.searchsorted(w.text, np.arange(len(texts) + 1))
    for a, b in zip(bounds, bounds[1:], strict=False):
        own = w.own[a:b]
        total = np.zeros(p.buckets)
        for word, n in zip(*np.unique(own, return_counts=True), strict=True):
            np.add.at(total, buckets[starts[word] : starts[word + 1]], n)
        for k in range(p.bigram_hashes):
            total += np.bincount(bigram_buckets(hashes[own[:-1]], hashes[own[1:]], k, p), minlength=p.buckets)
        ids = np.flatnonzero(total)
        yield ids.astype(np.uint16), (total[ids] / max(1.0, total.sum())).astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], p: Params) -> tuple[np.ndarray, float]:
    """Learns from (buckets, shares, label) rows, buckets of any integer type; returns each bucket's logit difference and the bias.

    The learning rate falls linearly to nothing, as is usual for such models.
    """
    rng = np.random.default_rng(p.seed)
    embed = rng.uniform(-1 / p.dim, 1 / p.dim, (p.buckets, p.dim)).astype(np.float32)
    layer, bias = np.zeros((2, p.dim), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, p.epochs * len(rows)), 0
    for _ in range(p.epochs):
        for k in rng.permutation(len(rows)):
            ids, share, label = rows[k]
            ids = ids.astype(np.int64)
            rate = p.rate * (1 - done / steps)
            done += 1
            own = embed[ids]
            mean = share @ own
            logits = layer @ mean + bias
            prob = np.exp(logits - logits.max())
            prob /= prob.sum()
            prob[label] -= 1
            back = layer.T @ prob
            layer -= rate * np.outer(prob, mean)
            bias -= rate * 0.1 * prob
            embed[ids] = own - (rate * p.embedding_rate) * share[:, None] * back
    return embed @ (layer[1] - layer[0]), float(bias[1] - bias[0])


def _extract(p: Params):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rows in chunks(zip(pdf["label"], pdf["text"], strict=True), lambda r: len(r[1] or ""), TEXT_CHARS):
                for (label, _), (ids, share) in zip(rows, features([t for _, t in rows], p), strict=True):
                    yield pd.DataFrame({"label": [label], "ids": [ids.tobytes()], "share": [share.tobytes()]})

    return run


def _fitted(p: Params):
    """The model, as one row, of all rows of features."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = sorted(((ids, share, label) for pdf in batches for ids, share, label in zip(pdf["ids"], pdf["share"], pdf["label"], strict=True)), key=lambda r: r)
        # Arrays over the bytes that came: no second copy of them.
        rows = [(np.frombuffer(ids, np.uint16), np.frombuffer(share, np.float32), label) for ids, share, label in got]
        logits, bias = fit(rows, p)
        yield pd.DataFrame({"logits": [logits.tobytes()], "bias": [bias]})

    return run


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> tuple[np.ndarray, float]:
    """Fits on at most ``p.max_train_docs`` of the labelled documents, the first by a hash of their ids.

    A task fits, as its rows are bounded (some 20 kB of features a document); the driver gets the model alone.

    ``labels`` has doc_id and quality; the caller leaves out what must not be learnt from.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.lit(p.seed), "doc_id"), "doc_id").limit(p.max_train_docs)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    learnt = texts.select("label", "text").mapInPandas(_extract(p), "label int, ids binary, share binary")
    model = learnt.repartition(1).mapInPandas(_fitted(p), "logits binary, bias double").head()
    # A plan that Spark finds to be empty runs no task.
    return (np.frombuffer(model.logits, np.float32), model.bias) if model else fit([], p)


def scores(model: tuple[np.ndarray, float], texts: list[str | None], p: Params = Params()) -> np.ndarray:
    """The probability of label 1 of each text."""
    logits, bias = model
    w = _Words(texts)
    buckets, owner, hashes = word_features(w.distinct, p)
    by_word = np.bincount(owner, logits[buckets], len(w.distinct)), np.bincount(owner, minlength=len(w.distinct))
    total, n = (np.bincount(w.text, x[w.own], len(texts)) for x in by_word)
    first, second, text = hashes[w.own[w.after - 1]], hashes[w.own[w.after]], w.text[w.after]
    for k in range(p.bigram_hashes):
        total += np.bincount(text, logits[bigram_buckets(first, second, k, p)], len(texts))
    n += p.bigram_hashes * np.bincount(text, minlength=len(texts))
    return 1.0 / (1.0 + np.exp(-np.clip(bias + total / np.maximum(n, 1), -50.0, 50.0)))


def scorer(model: tuple[np.ndarray, float], p: Params = Params()):
    """A pandas function: text to the probability of label 1."""

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            out = [scores(model, rows, p) for rows in chunks(part, lambda t: len(t or "") + 1, TEXT_CHARS)]
            yield pd.Series(np.concatenate(out) if out else np.empty(0))

    return run


def classify(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 if the score reaches the threshold)."""
    scored = docs.withColumn("score", scorer(train(docs, labels, p), p)("text"))
    return scored.withColumn("predicted", (F.col("score") >= p.threshold).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``docs`` that are predicted to be good."""
    return docs.filter(scorer(train(docs, labels, p), p)("text") >= p.threshold)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether the checksum of the id's text leaves no remainder; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))
