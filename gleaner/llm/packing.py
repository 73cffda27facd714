"""Best-fit packing: documents as token sequences of a fixed size at most, improved by swaps between underfull bins.

1.  ``_pack_texts``: tasks tokenize texts, append the end id and cut documents longer than a sequence into pieces, full ones but
    for the first; full pieces are sequences.  The others are packed block by block, where their ids are: best fit, longest
    first, then local search.
2.  Local search (``improve``) dissolves the emptiest bins.  One or two pieces of such a bin move to another underfull bin, or are
    exchanged there for one or two smaller pieces, so that the other bin is filled better; each step increases the sum of
    squared fills.  Exchanges that fill a bin exactly come first.  Full bins leave the search, emptied ones are gone.
3.  Bins that stay underfull are opened and dealt anew, at random, to blocks of bounded size (``_pack_bins``), until one block
    holds them all or a round no longer saves bins.  Only their ids are shuffled, those of full sequences never.

What a task holds is bounded by ``BLOCK_PIECES`` and ``BLOCK_TOKENS``, whatever the table's size; nothing goes through the driver but
counts.  Every round is a written table: lost executors cost a task of it.

Edge cases: null and empty texts are the end id alone; null and repeated doc_ids are documents of their own; a text of exactly
a sequence isn't cut; a special token's string is that token, as the library reads it; texts of any length are whole; an
empty table has no sequences; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.byte_tokens import coder as coder_of
from gleaner.llm.common import chunks, written

TOKENIZER, END_ID, SEQUENCE = "byte_bpe_50k.json", 2, 1024
#: Characters that are tokenized at once; pieces and tokens that are packed at once.
TEXT_CHARS, BLOCK_PIECES, BLOCK_TOKENS = 2_000_000, 20_000, 8_000_000
#: Rounds of dealing underfull bins anew at most, and the share of them that a round must save to be followed by another.
ROUNDS, LEAST_SAVING = 6, 0.002
#: Exchanges that one bin is dissolved by at most.
PATIENCE = 200

_PACKED = "sequence_id long, n_tokens int, open boolean, doc_id array<long>, piece array<int>, start array<long>, length array<int>, ids binary"
_ARROW = pa.schema(
    [("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("open", pa.bool_()), ("doc_id", pa.list_(pa.int64())), ("piece", pa.list_(pa.int32())), ("start", pa.list_(pa.int64())), ("length", pa.list_(pa.int32())), ("ids", pa.binary())]
)


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Bins of places in ``sizes``: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(room + 1)]
    some = 0  # bit f: a bin has f free
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        fits = some >> sizes[i]
        if fits:
            free = sizes[i] + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                some ^= 1 << free
        else:
            b, free = len(bins), room
            bins.append([])
        bins[b].append(i)
        free -= sizes[i]
        if free:
            by_free[free].append(b)
            some |= 1 << free
    return bins


class _Search:
    """Underfull bins by what they could take: with ``free`` left and pieces of summed size d given up, up to d + free."""

    def __init__(self, bins: list[list[int]], sizes: list[int], room: int):
        self.bins, self.sizes, self.room = bins, sizes, room
        self.fill = [sum(sizes[i] for i in b) for b in bins]
        #: By d + free: by d and the number of pieces given up: bins, and those pieces.
        self.takes: list[dict[tuple[int, int], dict[int, tuple[int, ...]]]] = [{} for _ in range(room + 1)]
        self.some = 0  # bit k: a bin could take k
        self.keys: dict[int, list[tuple[int, tuple[int, int]]]] = {}
        for b in range(len(bins)):
            self.enter(b)

    def given(self, b: int) -> dict[int, tuple[int, ...]]:
        """Size of each single piece and pair of pieces of a bin; one for each size, single ones first."""
        one = {self.sizes[i]: (i,) for i in self.bins[b]}
        own = list(one.items())
        pairs = {x + y: p + q for k, (x, p) in enumerate(own) for y, q in own[k + 1 :]}
        return pairs | one

    def enter(self, b: int) -> None:
        free = self.room - self.fill[b]
        if not free or not self.bins[b]:
            return
        keys = []
        for d, out in [(0, ()), *self.given(b).items()]:
            kind = (d, len(out))
            self.takes[d + free].setdefault(kind, {})[b] = out
            self.some |= 1 << (d + free)
            keys.append((d + free, kind))
        self.keys[b] = keys

    def leave(self, b: int) -> None:
        for key, kind in self.keys.pop(b, ()):
            own = self.takes[key][kind]
            del own[b]
            if not own:
                del self.takes[key][kind]
                if not self.takes[key]:
                    self.some &= ~(1 << key)

    def place(self, b: int, size: int, n: int, exact: bool) -> tuple[int, tuple[int, ...]] | None:
        """A bin for ``n`` pieces of this summed size out of bin b, and what it gives up, as little as can be.

        The sum of squares grows if bin b is emptier than the other will be, room - key + size."""
        most = size if exact else min(self.room, self.room + size - self.fill[b] - 1)
        fits = self.some >> size
        while fits:
            key = size + (fits & -fits).bit_length() - 1
            if key > most:
                return None
            kind = min((k for k in self.takes[key] if k[0] < size and k[1] + n <= 3), default=None)
            if kind is not None:
                return next(iter(self.takes[key][kind].items()))
            fits &= fits - 1
        return None

    def swap(self, b: int, own: tuple[int, ...], x: int, out: tuple[int, ...]) -> None:
        self.leave(x)
        self.bins[b] = [i for i in self.bins[b] if i not in own] + list(out)
        self.bins[x] = [i for i in self.bins[x] if i not in out] + list(own)
        for k in (b, x):
            self.fill[k] = sum(self.sizes[i] for i in self.bins[k])
        self.enter(x)

    def dissolve(self, b: int) -> None:
        """Gives the pieces of a bin to others while that increases the sum of squares."""
        self.leave(b)
        for _ in range(PATIENCE):
            if not self.bins[b]:
                return
            offers = sorted(self.given(b).items(), reverse=True)
            for exact in (True, False):
                found = next(((own, at) for size, own in offers if size <= self.room and (at := self.place(b, size, len(own), exact))), None)
                if found:
                    break
            else:
                break
            self.swap(b, found[0], *found[1])
        self.enter(b)


def improve(bins: list[list[int]], sizes: list[int], room: int) -> list[list[int]]:
    """Fewer or fuller bins by exchanges; passes over all underfull bins, emptiest first, while they save bins."""
    search = _Search(bins, sizes, room)
    left = len(bins) + 1
    while (now := sum(map(bool, search.bins))) < left:
        left = now
        for b in sorted((b for b, f in enumerate(search.fill) if 0 < f < room), key=search.fill.__getitem__):
            if 0 < search.fill[b] < room:
                search.dissolve(b)
    return [b for b in search.bins if b]


def pack_sizes(sizes: list[int], room: int) -> list[list[int]]:
    """Bins of places in ``sizes`` (1 to ``room`` each), few of them."""
    return improve(best_fit(sizes, room), sizes, room)


class _Rows:
    """Sequences as rows; ids are numbered by round and task."""

    def __init__(self, round_: int):
        self.next = (round_ << 56) | (TaskContext.get().partitionId() << 32)

    def of(self, bins: list[list[int]], pieces: list[tuple], ids: list[np.ndarray], room: int, last: bool) -> pa.RecordBatch:
        """Rows of bins of ``pieces`` (doc_id, piece, start); bins with room stay open unless these are the ``last``."""
        n = [sum(len(ids[i]) for i in b) for b in bins]
        columns = [
            range(self.next, self.next + len(bins)), n, [k < room and not last for k in n], *[[[pieces[i][c] for i in b] for b in bins] for c in range(3)],
            [[len(ids[i]) for i in b] for b in bins], [np.concatenate([ids[i] for i in b]).tobytes() for b in bins],
        ]
        self.next += len(bins)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


#: Sequences in a batch of rows.
_BATCH = 2_000


def _batches(rows: _Rows, bins: list[list[int]], *rest) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(bins), _BATCH):
        yield rows.of(bins[k : k + _BATCH], *rest)


def _pack_texts(tokenizer: str, end_id: int, room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, rows = coder_of(tokenizer), _Rows(0)
        kind = "<u2" if max(coder.size, end_id + 1) <= 1 << 16 else "<u4"
        pieces, ids, held = [], [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            yield from _batches(rows, pack_sizes(list(map(len, ids)), room), pieces, ids, room, False)

        texts = (r for b in batches for r in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True))
        for part in chunks(texts, lambda r: len(r[1] or ""), TEXT_CHARS):
            flat, n = coder.encode([t for _, t in part])
            flat = np.insert(flat, np.cumsum(n), end_id).astype(kind)
            whole, whole_ids, at = [], [], 0
            for (doc, _), size in zip(part, (n + 1).tolist(), strict=True):
                first, start = (size % room or room) if size > room else size, 0
                for k in range(-(-size // room)):
                    end = first + k * room
                    own = flat[at + start : at + end]
                    (whole if end - start == room else pieces).append((doc, k, start))
                    (whole_ids if end - start == room else ids).append(own)
                    held += end - start if end - start < room else 0
                    start = end
                at += size
            yield from _batches(rows, [[k] for k in range(len(whole))], whole, whole_ids, room, False)
            if len(ids) >= BLOCK_PIECES or held >= BLOCK_TOKENS:
                yield from packed()
                pieces, ids, held = [], [], 0
        if ids:
            yield from packed()
        coder.rest()

    return run


def _pack_bins(round_: int, room: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, pieces, ids = _Rows(round_), [], []
        for b in batches:
            for r in b.to_pylist():
                flat = np.frombuffer(r["ids"], "<u2" if len(r["ids"]) == 2 * r["n_tokens"] else "<u4")
                ids += np.split(flat, np.cumsum(r["length"])[:-1])
                pieces += zip(r["doc_id"], r["piece"], r["start"], strict=True)
        if ids:
            yield from _batches(rows, pack_sizes(list(map(len, ids)), room), pieces, ids, room, last)

    return run


def pack(docs: DataFrame, sequence: int = SEQUENCE, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Sequences of ``docs`` (doc_id, text): sequence_id, n_tokens, the doc_id, piece, start and length of each piece in order, and
    ``ids``, all token ids as little-endian unsigned numbers of 16 bits (32 where the vocabulary needs them)."""
    if sequence < 1:
        raise ValueError("a sequence of at least one token")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kept = {"parquet.enable.dictionary": "false"}
    packed = written(rows.mapInArrow(_pack_texts(tokenizer, end_id, sequence), _PACKED), "packed", **kept)
    done = packed.filter("NOT open")
    for round_ in range(1, ROUNDS + 1):
        left = packed.filter("open")
        bins, pieces, tokens = left.agg(F.count(F.lit(1)), F.sum(F.size("length")), F.sum("n_tokens")).head()
        if not bins:
            return done.drop("open")
        blocks = max(-(-pieces // BLOCK_PIECES), -(-tokens // BLOCK_TOKENS))
        # The hash deals out bins evenly, a little below the bound of a block in the mean.
        dealt = left.coalesce(1) if blocks == 1 else left.repartition(blocks + blocks // 8 + 1, F.xxhash64("sequence_id", F.lit(round_)))
        packed = written(dealt.mapInArrow(_pack_bins(round_, sequence, blocks == 1), _PACKED), "packed", **kept)
        done = done.unionByName(packed.filter("NOT open"))
        if blocks == 1 or packed.count() > (1 - LEAST_SAVING) * bins:
            break
    return done.unionByName(packed.filter("open")).drop("open")


def _ids(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for r in b.to_pylist():
            flat, at = _ids(r["ids"], r["n_tokens"]).astype("<u4"), 0
            for doc, piece, start, n in zip(r["doc_id"], r["piece"], r["start"], r["length"], strict=True):
                rows.append((doc, piece, start, n, zlib.crc32(flat[at : at + n]), r["sequence_id"], at))
                at += n
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [[]] * len(_PIECES), _PIECES, strict=True)], schema=_PIECES)


def pieces(packed: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (of the ids as unsigned 32-bit numbers), sequence_id and offset of every piece."""
    return packed.mapInArrow(_digested, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the token ids of every sequence as a list."""
    shape = pa.schema([("sequence_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [_ids(d, n).astype(np.int32) for d, n in zip(b["ids"].to_pylist(), b["n_tokens"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["sequence_id"], pa.array(own, shape.field("ids").type)], schema=shape)

    return packed.select("sequence_id", "n_tokens", "ids").mapInArrow(run, "sequence_id long, ids array<int>")
