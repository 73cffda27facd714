"""Line dedup: a sharded minimal perfect hash indexes compact arrays that documents probe.

``count_lines`` finds, with partial sums before the shuffle, how many documents hold each distinct line key and the
largest ``doc_id`` among them.  ``build_index`` cuts the hashes of the keys found often enough into shards and gives
each a minimal perfect hash with three arrays: a 64-bit fingerprint (with the 64 bits that are hashed, 128 bits
decide; a shard in which two keys share the hashed bits hashes a mix of all under a seed that it keeps), the count of documents and the keeper.  ``dedup`` probes the arrays line by line.  While the whole index is
at most ``RESIDENT_BYTES`` every worker holds it and texts aren't shuffled; beyond, compact probes are routed to the
shards and only their answers are joined to the documents, so memory stays bounded at any size.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased.

Edge cases: a null or empty text is one empty line; every row is a document of its own; rows with the keeper's
``doc_id`` all keep the line, and so do its repeats within such a row; a null ``doc_id`` is below all others; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import SPACE, chunks, forget, mix64, written
from gleaner.llm.mph import PerfectHash

MIN_CHARS, MIN_DOCS = 20, 3
SHARD_KEYS, RESIDENT_BYTES, PROBES_A_TASK = 500_000, 48_000_000, 2_000_000
_RESULT = "doc_id long, n_lines long, n_dropped long, text string"


def hashed_lines(text: str | None, min_chars: int) -> tuple[list[str], list[int], np.ndarray]:
    """The lines, the numbers of those with a key of at least ``min_chars`` code points, and their 128-bit hashes (n, 2)."""
    lines = (text or "").split("\n")
    at, parts = [], []
    for k, line in enumerate(lines):
        if len(line) >= min_chars and len(key := line.strip(SPACE)) >= min_chars:
            at.append(k)
            parts.append(xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()))
    return lines, at, np.frombuffer(b"".join(parts), ">u8").astype(np.uint64).reshape(-1, 2)


def _hash_rows(min_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, parts = [], []
            for k, text in enumerate(pdf["text"]):
                _, _, h = hashed_lines(text, min_chars)
                if len(h):
                    parts.append(np.unique(h, axis=0) if len(h) > 1 else h)
                    rows.append(np.full(len(parts[-1]), k))
            h = np.concatenate(parts).view(np.int64) if parts else np.empty((0, 2), np.int64)
            own = np.concatenate(rows) if rows else np.empty(0, np.int64)
            yield pd.DataFrame({"h1": h[:, 0], "h2": h[:, 1], "doc_id": pdf["doc_id"].to_numpy(np.int64)[own], "no_id": pdf["no_id"].to_numpy(bool)[own]})

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, no_id (it is null, and given as 0) and text."""
    own = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(own, F.lit(0)).alias("doc_id"), own.isNull().alias("no_id"), "text")


def count_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2, n_docs and keeper of each distinct line key; the keeper is null where only null ids hold the key."""
    rows = _keyed(docs).mapInPandas(_hash_rows(min_chars), "h1 long, h2 long, doc_id long, no_id boolean")
    return rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max(F.when(~F.col("no_id"), F.col("doc_id"))).alias("keeper"))


def _keys(h1: np.ndarray, h2: np.ndarray, seed: int) -> np.ndarray:
    """The 64 bits that are hashed: the first ones, or under a seed a mix of all 128."""
    return mix64(h1 ^ mix64(h2 + np.uint64(seed))) if seed else h1


class LineIndex:
    """A shard: fingerprints, keepers, counts and whether the keeper is null, in the order of the perfect hash, behind the seed of its keys."""

    def __init__(self, data: bytes):
        (self._seed,) = struct.unpack_from("<I", data)
        data = memoryview(data)[4:]
        self._hash, at = PerfectHash.load(data)
        n = self._hash.n
        self._print = np.frombuffer(data, "<u8", n, at)
        self._keeper = np.frombuffer(data, "<i8", n, at + 8 * n)
        self._count = np.frombuffer(data, "<u4", n, at + 16 * n)
        self._no_keeper = np.frombuffer(data, "?", n, at + 20 * n)

    @staticmethod
    def dump(h1: np.ndarray, h2: np.ndarray, keeper: np.ndarray, count: np.ndarray, no_keeper: np.ndarray) -> bytes:
        # Where two keys of the shard share the bits that are hashed, others are.
        seed = next(k for k in range(64) if len(np.unique(_keys(h1, h2, k))) == len(h1))
        keys = _keys(h1, h2, seed)
        hashed = PerfectHash.build(keys)
        order = np.argsort(hashed(keys))
        arrays = (h2.astype("<u8"), keeper.astype("<i8"), np.minimum(count, 0xFFFFFFFF).astype("<u4"), no_keeper)
        return struct.pack("<I", seed) + hashed.dump() + b"".join(a[order].tobytes() for a in arrays)

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count of documents (0: not in the index), keeper and whether it is null, of each hash."""
        at = self._hash(_keys(h1, h2, self._seed))
        ok = at >= 0
        ok[ok] = self._print[at[ok]] == h2[ok]
        at = np.where(ok, at, 0)
        if not self._hash.n:
            return np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64), np.zeros(len(h1), bool)
        return np.where(ok, self._count[at], 0).astype(np.int64), self._keeper[at], self._no_keeper[at]


def _shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return ((h1 >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    h1, h2 = (pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
    data = LineIndex.dump(h1, h2, pdf["keeper"].to_numpy(np.int64), pdf["n_docs"].to_numpy(np.int64), pdf["no_keeper"].to_numpy(bool))
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "data": [data]})


def build_index(counted: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, int]:
    """The written shards (shard, data) over keys of at least ``min_docs`` documents, and how many there are."""
    often = written(counted.filter(F.col("n_docs") >= min_docs), "often-lines")
    shards = max(1, -(-often.count() // SHARD_KEYS))
    shard = F.shiftrightunsigned(F.shiftrightunsigned("h1", 32) * shards, 32).cast("int")
    filled = {"shard": shard, "no_keeper": F.col("keeper").isNull(), "keeper": F.coalesce("keeper", F.lit(0))}
    index = written(often.withColumns(filled).groupBy("shard").applyInPandas(_build, "shard int, data binary"), "line-index")
    forget(often)
    return index, shards


def _dropped(counts: np.ndarray, keepers: np.ndarray, no_keeper: np.ndarray, doc_ids: np.ndarray, no_id: np.ndarray, min_docs: int) -> np.ndarray:
    return (counts >= min_docs) & ((keepers != doc_ids) | (no_keeper != no_id))


def _kept(doc_id: int, no_id: bool, lines: list[str], drop: set[int]) -> tuple:
    return None if no_id else doc_id, len(lines), len(drop), "\n".join(x for k, x in enumerate(lines) if k not in drop)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "n_lines", "n_dropped", "text"])
    return out.assign(doc_id=pd.Series([r[0] for r in rows], dtype="Int64"))


def _probe_resident(data: Broadcast, shards: int, min_chars: int, min_docs: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = {k: LineIndex(x) for k, x in data.value.items()}
        for pdf in batches:
            for rows in chunks(zip(pdf["doc_id"], pdf["no_id"], pdf["text"], strict=True), lambda r: len(r[2] or ""), 4_000_000):
                split = [hashed_lines(t, min_chars) for *_, t in rows]
                h, each = np.concatenate([x[2] for x in split]), [len(x[1]) for x in split]
                owner, nameless = (np.repeat(np.array([r[k] for r in rows], t), each) for k, t in ((0, np.int64), (1, bool)))
                drop, shard = np.zeros(len(h), bool), _shard_of(h[:, 0], shards).astype(np.int64)
                for k in np.unique(shard):
                    if k in index:
                        own = np.flatnonzero(shard == k)
                        drop[own] = _dropped(*index[k].probe(h[own, 0], h[own, 1]), owner[own], nameless[own], min_docs)
                out, at = [], 0
                for (d, none, _), (lines, nos, _) in zip(rows, split, strict=True):
                    out.append(_kept(d, none, lines, {n for n, x in zip(nos, drop[at : at + len(nos)], strict=True) if x}))
                    at += len(nos)
                yield _frame(out)

    return run


def _probe_rows(shards: int, salts: int, min_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, none, tie, text in zip(pdf["doc_id"], pdf["no_id"], pdf["tie"], pdf["text"], strict=True):
                _, _, h = hashed_lines(text, min_chars)
                h = np.unique(h, axis=0)
                yield pd.DataFrame({"shard": _shard_of(h[:, 0], shards).astype(np.int32), "salt": np.full(len(h), tie % salts, np.int32), "h1": h[:, 0].view(np.int64), "h2": h[:, 1].view(np.int64), "doc_id": d, "no_id": none, "tie": tie})

    return run


def _answer(min_docs: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, index = None, None
        for pdf in batches:
            for key, own in pdf.groupby("shard", sort=False):
                data = own["data"].dropna()
                if len(data):  # sorted first in its shard
                    shard, index = key, LineIndex(data.iloc[0])
                own = own[own["data"].isna()]
                if key != shard or not len(own):
                    continue
                h1, h2, d = (own[c].to_numpy(np.int64) for c in ("h1", "h2", "doc_id"))
                hit = _dropped(*index.probe(h1.view(np.uint64), h2.view(np.uint64)), d, own["no_id"].to_numpy(bool), min_docs)
                yield own.loc[hit, ["doc_id", "no_id", "tie", "h1", "h2"]]

    return run


def _apply_answers(min_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d, none, text, bad in zip(pdf["doc_id"], pdf["no_id"], pdf["text"], pdf["bad"], strict=True):
                lines, nos, h = hashed_lines(text, min_chars)
                found = {(r["h1"], r["h2"]) for r in bad} if bad is not None else ()
                out.append(_kept(d, none, lines, {n for n, (a, b) in zip(nos, h.view(np.int64).tolist(), strict=True) if (a, b) in found} if found else set()))
            yield _frame(out)

    return run


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, resident_bytes: int = RESIDENT_BYTES) -> DataFrame:
    """doc_id, n_lines (before), n_dropped and the text that stays of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    index, shards = build_index(count_lines(docs, min_chars), min_docs)
    size = index.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).head()[0]
    if size <= resident_bytes:
        data = spark.sparkContext.broadcast({r.shard: bytes(r.data) for r in index.toLocalIterator()})
        return _keyed(docs).mapInPandas(_probe_resident(data, shards, min_chars, min_docs), _RESULT)
    # Probes of one line are spread over salts; each salt gets its own copy of the shard.
    keyed = _keyed(docs).withColumn("tie", F.xxhash64("text"))
    lines = written(keyed.mapInPandas(_probe_rows(shards, 1 << 20, min_chars), "shard int, salt int, h1 long, h2 long, doc_id long, no_id boolean, tie long"), "line-probes")
    salts = max(1, -(-lines.count() // (shards * PROBES_A_TASK)))
    blank = [F.lit(0).cast(t).alias(c) for c, t in (("h1", "long"), ("h2", "long"), ("doc_id", "long"), ("no_id", "boolean"), ("tie", "long"))]
    copies = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), *blank, "data")
    probes = lines.withColumn("salt", F.pmod("salt", F.lit(salts)).cast("int")).withColumn("data", F.lit(None).cast("binary"))
    placed = probes.unionByName(copies).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("data").isNull())
    answers = placed.mapInPandas(_answer(min_docs), "doc_id long, no_id boolean, tie long, h1 long, h2 long")
    bad = answers.groupBy("doc_id", "no_id", "tie").agg(F.collect_set(F.struct("h1", "h2")).alias("bad"))
    # A document's own lines bound its list of answers.
    both = keyed.join(bad, ["doc_id", "no_id", "tie"], "left").select("doc_id", "no_id", "text", "bad")
    return both.mapInPandas(_apply_answers(min_chars), _RESULT)
