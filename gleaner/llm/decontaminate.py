"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` cuts the documents into shards of whole documents (about ``SHARD_CHARS`` characters each) and stores, for
every term of the shard, the sorted word positions at which it occurs: one row per shard, in a written table that any number
of benchmarks can be searched in.  The index is parted by document, so its size follows the corpus, no term's list is ever
gathered in one task, and a search needs no shuffle of it.  ``hits`` takes each distinct window of benchmark words, starts
from the postings of its rarest term in the shard, and intersects them with the next rarest lists, each shifted by the term's
offset, until none is left or all terms agree: exact phrase matches, for all windows of a block at once.  ``near`` relaxes
the offsets to a stretch of words.  Benchmarks of any size are read and searched in blocks of ``BLOCK_WORDS`` words; a block
adds its hits, a row for each document that has some, and the driver holds one block at a time.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; terms are their 64-bit hashes.  Positions
leave a gap between documents, so that no match crosses their border.

Edge cases: null and empty texts have no words and are never contaminated; a text of any length is indexed whole, in a shard
of its own if it is longer than one; items without words are skipped; items of fewer words than a window are one window; a
null item_id can hit words but isn't listed; repeated rows, of documents or items, count as rows and as one item id; an empty
benchmark leaves all clean; an empty table gives an empty result; extra columns are ignored by ``search`` and ``near`` and
kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import chunks, small, unused, written

WINDOW, SHARE = 13, 20
SHARD_CHARS, BLOCK_WORDS = 4_000_000, 500_000
#: Candidate positions of windows that are intersected at once.
CANDIDATES = 2_000_000
#: Up to this many rows with hits are joined by a broadcast; more by a shuffle.
SMALL_HITS = 300_000

_SEPARATORS = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
_PARTED = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))

_INDEX = "doc_id binary, no_id binary, starts binary, terms binary, sizes binary, positions binary"
_HITS = "shard long, doc int, runs array<struct<begin:int,end:int>>, items array<string>"
_DOCS = "shard long, doc int, doc_id long, n_words long"


def _parted(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower().translate(_PARTED) if text else b""


def words(text: str | None) -> list[bytes]:
    return _parted(text).split()


def _hashes(distinct: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))


def _positions(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sorted terms of all texts, each word's term among them, its position, and the first position of each text and of
    the end."""
    parted = list(map(_parted, texts))
    data = np.frombuffer(b" ".join(parted) + b" ", np.uint8)
    full = data != 0x20
    begins = np.flatnonzero(full[1:] & ~full[:-1]) + 1 if len(data) else np.empty(0, np.int64)
    if len(data) and full[0]:
        begins = np.concatenate([[0], begins])
    text_ends = np.cumsum(np.fromiter(map(len, parted), np.int64, len(parted)) + 1)
    n_words = np.diff(np.searchsorted(begins, text_ends), prepend=0)
    # The words' bytes after one another, as an Arrow array without copies of words.
    before = np.cumsum(full, dtype=np.int64)
    offsets = np.append(before[begins] - 1, before[-1] if len(before) else 0)
    own = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data[full])])
    coded = own.dictionary_encode()
    terms, number = np.unique(_hashes(coded.dictionary.to_pylist()), return_inverse=True)
    at = np.arange(len(begins)) + np.repeat(np.arange(len(texts)), n_words)
    return terms, number[coded.indices.to_numpy()], at, np.concatenate([[0], np.cumsum(n_words + 1)])


def _shard(rows: list) -> pd.DataFrame:
    terms, rank, at, starts = _positions([t for *_, t in rows])
    sizes = np.bincount(rank, minlength=len(terms))
    # By term, then by position; differences compress better.
    positions = (np.sort((rank.astype(np.uint64) << np.uint64(32)) | at.astype(np.uint64)) & np.uint64(0xFFFFFFFF)).astype("<u4")
    apart = np.diff(positions, prepend=np.uint32(0))
    cells = (np.array([d for d, *_ in rows], "<i8"), np.array([z for _, z, _ in rows], np.uint8), starts.astype("<u4"), terms.astype("<u8"), sizes.astype("<u4"), apart.astype("<u4"))
    return pd.DataFrame([[c.tobytes() for c in cells]], columns=[c.split()[0] for c in _INDEX.split(", ")])


def _index_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = (r for pdf in batches for r in zip(pdf["doc_id"], pdf["no_id"], pdf["text"], strict=True))
    for part in chunks(rows, lambda r: len(r[2] or "") + 6, SHARD_CHARS):
        yield _shard(part)


def build_index(docs: DataFrame) -> DataFrame:
    """The written index of ``docs`` (doc_id, text): the postings of all their terms, by shard."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")
    return written(rows.mapInPandas(_index_shards, _INDEX).withColumn("shard", F.monotonically_increasing_id()), "postings")


@dataclass
class Windows:
    """The distinct windows of a block of items, by length: their terms' numbers, and the items that hold each (of window k
    ``items[bounds[k] : bounds[k + 1]]``)."""

    names: list[str | None]
    terms: np.ndarray
    by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, items: list[tuple[str | None, list[bytes]]], window: int) -> Windows:
        names = [name for name, _ in items]
        flat = _hashes([w for _, own in items for w in own])
        terms, number = np.unique(flat, return_inverse=True)
        number = number.astype(np.int32)
        ends = np.cumsum([len(own) for _, own in items], dtype=np.int64) if items else np.empty(0, np.int64)
        places: dict[int, list[tuple[int, int]]] = {}  # by length: where a window begins, and its item
        for k, (end, (_, own)) in enumerate(zip(ends.tolist(), items, strict=True)):
            n = min(window, len(own))
            if n:
                places.setdefault(n, []).extend((a, k) for a in range(end - len(own), end - n + 1))
        by_length = []
        for n, own in sorted(places.items()):
            begins, item = np.array(own, np.int64).T
            distinct, which = np.unique(number[begins[:, None] + np.arange(n)], axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.reshape(-1), item], axis=1), axis=0)
            by_length.append((distinct, np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), pairs[:, 1]))
        return cls(names, terms, by_length)


class _Shard:
    def __init__(self, row):
        self.shard = row.shard
        self.starts = np.frombuffer(row.starts, "<u4").astype(np.int64)
        self.terms = np.frombuffer(row.terms, "<u8")
        self.sizes = np.frombuffer(row.sizes, "<u4").astype(np.int64)
        self.positions = np.cumsum(np.frombuffer(row.positions, "<u4"), dtype=np.uint32).astype(np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        #: All postings in one ascending array: term's number, then position.
        self.keys = (np.repeat(np.arange(len(self.terms)), self.sizes) << 32) | self.positions

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """The numbers of terms in this shard; -1 for those that it hasn't."""
        if not len(self.terms):
            return np.full(len(terms), -1, np.int64)
        k = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[k] == terms, k, -1)

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.begins[term] : self.begins[term] + self.sizes[term]]

    def docs_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1

    def present(self, windows: Windows) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """By length: number in the list, the windows that have all their terms here, their terms, and the order of these
        from the rarest."""
        known = self.numbers(windows.terms)
        for k, (distinct, *_) in enumerate(windows.by_length):
            own = known[distinct]
            held = np.flatnonzero((own >= 0).all(axis=1))
            if len(held):
                own = own[held]
                yield k, held, own, np.argsort(self.sizes[own], axis=1, kind="stable")

    def phrases(self, windows: Windows) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By length: windows that occur (numbers) and where they begin."""
        for k, held, terms, order in self.present(windows):
            rarest = terms[np.arange(len(held)), order[:, 0]]
            ends = np.cumsum(self.sizes[rarest])
            cuts = np.searchsorted(ends, np.arange(CANDIDATES, int(ends[-1]) + CANDIDATES, CANDIDATES), side="right")
            for a, b in zip([0, *cuts], [*cuts, len(held)], strict=False):
                a, b = int(a), max(int(b), min(int(a) + 1, len(held)))
                if a < b:
                    which, at = self._intersected(terms[a:b], order[a:b])
                    yield k, held[a + which], at

    def _intersected(self, terms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(len(terms))
        first = terms[rows, order[:, 0]]
        sizes = self.sizes[first]
        which = np.repeat(rows, sizes)
        at = self.positions[np.repeat(self.begins[first] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(which))] - order[which, 0]
        for j in range(1, terms.shape[1]):
            offset = order[which, j]
            wanted = (terms[which, offset] << 32) | (at + offset)
            same = (at >= 0) & (self.keys[np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)] == wanted)
            which, at = which[same], at[same]
        return which, at

    def stretches(self, windows: Windows, span: int) -> Iterator[tuple[int, int, int]]:
        """Number of the list, window and document of each window all of whose terms lie within ``span`` words."""
        for k, held, terms, order in self.present(windows):
            for window, own, by in zip(held.tolist(), terms, order, strict=True):
                distinct = list(dict.fromkeys(own[by].tolist()))
                lists = [self.postings(t) for t in distinct]
                at = lists[0]
                for other in lists[1:]:  # from the rarest: only places that each other term is near to
                    at = at[np.searchsorted(other, at - span, side="right") < np.searchsorted(other, at + span)]
                docs = self.docs_of(at)
                for doc in np.unique(docs).tolist():
                    low, high = self.starts[doc], self.starts[doc + 1]
                    inside = [x[np.searchsorted(x, low) : np.searchsorted(x, high)] for x in lists]
                    if all(map(len, inside)) and _least_stretch(inside) <= span:
                        yield k, window, doc


def _least_stretch(lists: list[np.ndarray]) -> int:
    """Words of the shortest stretch that holds a position of each list."""
    at = np.concatenate(lists)
    kind = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    order = np.argsort(at)
    at, kind, last, least = at[order].tolist(), kind[order].tolist(), [-1] * len(lists), 1 << 62
    for p, k in zip(at, kind, strict=True):
        last[k] = p
        first = min(last)
        if first >= 0:
            least = min(least, p - first + 1)
    return least


def _blocks(benchmark: DataFrame) -> Iterator[list]:
    """(name, words) of the items with words, a block at a time."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator()
    items = ((r.item_id, own) for r in rows if (own := words(r.text)))
    return chunks(items, lambda x: len(x[1]), BLOCK_WORDS)


def _named(windows: Windows, k: int, docs: np.ndarray, which: np.ndarray) -> list[tuple[int, str]]:
    """The distinct (document, item name) of windows of the k-th length in documents; items without a name are left out."""
    _, bounds, items = windows.by_length[k]
    pairs = np.unique(np.stack([docs, which], axis=1), axis=0)
    return [(d, windows.names[i]) for d, w in pairs.tolist() for i in items[bounds[w] : bounds[w + 1]].tolist() if windows.names[i] is not None]


def _hit(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows = shared.value
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                shard, listed = _Shard(row), set()
                step = np.zeros(int(shard.starts[-1]) + 1, np.int32)
                for k, which, at in shard.phrases(windows):
                    np.add.at(step, at, 1)
                    np.add.at(step, at + windows.by_length[k][0].shape[1], -1)
                    listed.update(_named(windows, k, shard.docs_of(at), which))
                marked = np.diff(np.cumsum(step) > 0, prepend=False)
                edges = np.flatnonzero(marked)
                if not len(edges):
                    continue
                runs = np.stack([edges[::2], edges[1::2]], axis=1)
                by_doc: dict[int, tuple[list, list]] = {}
                for doc, (a, b) in zip(shard.docs_of(runs[:, 0]).tolist(), runs.tolist(), strict=True):
                    by_doc.setdefault(doc, ([], []))[0].append({"begin": a, "end": b})
                for doc, name in sorted(listed):
                    by_doc[doc][1].append(name)
                yield pd.DataFrame([(shard.shard, d, r, i) for d, (r, i) in by_doc.items()], columns=["shard", "doc", "runs", "items"])

    return run


def hits(index: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """shard, doc (its number there), n_hit and items of each document with words inside a window."""
    spark, parts = index.sparkSession, None
    postings = index.select("shard", "starts", "terms", "sizes", "positions")
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(Windows.of(block, window))
        part = written(postings.mapInPandas(_hit(shared), _HITS), "hits")
        shared.destroy()
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        parts = spark.createDataFrame([], _HITS)
    found = parts.groupBy("shard", "doc").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # Runs of several blocks may overlap; in order of their beginnings, each adds what lies behind the furthest end so far.
    first = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("runs", first, lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["begin"], a["end"]))).alias("n"), F.greatest(a["end"], r["end"]).alias("end")), lambda a: a["n"])
    return found.select("shard", "doc", covered.cast("long").alias("n_hit"), "items")


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            n_words = np.diff(np.frombuffer(row.starts, "<u4").astype(np.int64)) - 1
            ids = pd.Series(np.frombuffer(row.doc_id, "<i8"), dtype="Int64").mask(np.frombuffer(row.no_id, np.uint8).astype(bool))
            yield pd.DataFrame({"shard": row.shard, "doc": np.arange(len(n_words)), "doc_id": ids, "n_words": n_words})


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, index: DataFrame | None = None) -> DataFrame:
    """A row per document: its words, those inside any occurrence of a window, the items found, and whether
    hit words are at least one in ``share``.  ``index`` is one built from ``docs`` before, if there is one."""
    index = build_index(docs) if index is None else index
    every = index.select("shard", "doc_id", "no_id", "starts").mapInPandas(_documents, _DOCS)
    both = every.join(small(written(hits(index, benchmark, window), "documents-hit"), SMALL_HITS), ["shard", "doc"], "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return both.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """``docs`` without contaminated rows.  Rows are told apart by a hash of id and text, so null and repeated ids are right."""
    key = F.xxhash64("doc_id", "text")
    found = search(docs.select(key.alias("doc_id"), "text"), benchmark, window, share)
    row = unused(docs, "bad_row")
    bad = small(written(found.filter("contaminated").select(F.col("doc_id").alias(row)).distinct(), "contaminated"), SMALL_HITS)
    return docs.join(bad, key == F.col(row), "left_anti")


def _near(shared, span: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows = shared.value
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                shard, n = _Shard(row), {}
                for k, window, doc in shard.stretches(windows, span):
                    for _, name in _named(windows, k, np.array([doc]), np.array([window])):
                        n[doc, name] = n.get((doc, name), 0) + 1
                if n:
                    yield pd.DataFrame([(shard.shard, d, name, c) for (d, name), c in n.items()], columns=["shard", "doc", "item_id", "n"])

    return run


def near(docs: DataFrame, benchmark: DataFrame, span: int, window: int = WINDOW, index: DataFrame | None = None) -> DataFrame:
    """Proximity matches: doc_id, item_id and how many of the item's distinct windows have all their terms within some
    stretch of ``span`` words of the document.  Rows of one item_id add up."""
    index = build_index(docs) if index is None else index
    spark, parts = index.sparkSession, None
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(Windows.of(block, window))
        part = written(index.select("shard", "starts", "terms", "sizes", "positions").mapInPandas(_near(shared, span), "shard long, doc int, item_id string, n long"), "near")
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        parts = spark.createDataFrame([], "shard long, doc int, item_id string, n long")
    every = index.select("shard", "doc_id", "no_id", "starts").mapInPandas(_documents, _DOCS)
    found = parts.groupBy("shard", "doc", "item_id").agg(F.sum("n").alias("n_near"))
    return every.join(found, ["shard", "doc"]).select("doc_id", "item_id", "n_near")
