"""Static range asymmetric numeral system over token ids, interleaved over many lanes.

A block of tokens is laid out row by row over ``lanes`` independent 64-bit states (token ``i`` is in
lane ``i % lanes``), so each numpy step codes one token of every lane.  States stay in
``[2^31, 2^63)`` and are renormalised by 32-bit words.  All blocks share one static frequency table.
Every ``CHECKPOINT_ROWS`` rows the states and the stream position are kept, with the checksum of the
words up to the next checkpoint: segments decode, and are verified, independently of each other.

Block layout, little endian: ``MAGIC``, then u32 version, lanes, scale bits, tokens, segments, table
checksum and header checksum; for each segment u32 first word, u32 checksum and its u64 states;
at last the u32 words.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

MAGIC, VERSION = b"GRNS", 1
SCALE_BITS, CHECKPOINT_ROWS = 20, 256
_LOW, _WORD = np.uint64(1 << 31), np.uint64(32)
_HEAD = struct.Struct("<4s7I")


@dataclass(frozen=True)
class Table:
    """Frequencies summing to ``2^SCALE_BITS``; every symbol of the data has one of at least 1."""

    freq: np.ndarray
    cum: np.ndarray
    symbol: np.ndarray
    check: int

    @staticmethod
    def of_counts(counts: np.ndarray) -> Table:
        """Scale the counts (index: symbol) down; the most frequent symbols absorb the rounding."""
        counts = np.asarray(counts, np.int64)
        if not counts.sum():
            counts = np.array([1], np.int64)
        total, scale = int(counts.sum()), 1 << SCALE_BITS
        if (counts > 0).sum() > scale // 2:
            raise ValueError("the alphabet is too large for the table")
        freq = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) * (scale / total)).astype(np.int64)), 0)
        left = scale - int(freq.sum())
        for s in np.argsort(-freq, kind="stable"):
            if not left:
                break
            step = left if left > 0 else -min(-left, int(freq[s]) - 1)
            freq[s] += step
            left -= step
        return Table.of_freq(freq)

    @staticmethod
    def of_freq(freq: np.ndarray) -> Table:
        freq = np.asarray(freq, np.uint64)
        cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
        return Table(freq, cum, symbol, zlib.crc32(freq.astype("<u8").tobytes()))


def lanes_for(n: int) -> int:
    """A power of two up to 4096, with at least 32 rows unless the block is tiny."""
    return 1 << max(0, min(12, (n // 64).bit_length()))


def encode(ids: np.ndarray, table: Table) -> bytes:
    n = len(ids)
    lanes = lanes_for(n)
    rows = -(-n // lanes)
    padded = np.full(rows * lanes, int(np.argmax(table.freq)), np.int64)
    padded[:n] = ids
    grid = padded.reshape(rows, lanes)
    m, up = np.uint64(SCALE_BITS), np.uint64(63 - SCALE_BITS)
    x = np.full(lanes, _LOW, np.uint64)
    words: list[np.ndarray] = []
    states: dict[int, bytes] = {}
    for r in range(rows - 1, -1, -1):
        f, c = table.freq[grid[r]], table.cum[grid[r]]
        full = x >= (f << up)
        words.append(x[full].astype("<u4"))
        x[full] >>= _WORD
        q = x // f
        x = (q << m) + (x - q * f) + c
        if r % CHECKPOINT_ROWS == 0:
            states[r // CHECKPOINT_ROWS] = x.astype("<u8").tobytes()
    words.reverse()
    stream = np.concatenate(words) if words else np.empty(0, "<u4")
    firsts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    starts = [int(firsts[k * CHECKPOINT_ROWS]) for k in range(len(states))] + [len(stream)]
    parts = [struct.pack("<2I", starts[k], zlib.crc32(stream[starts[k] : starts[k + 1]].tobytes(), zlib.crc32(states[k]))) + states[k] for k in range(len(states))]
    fields = (VERSION, lanes, SCALE_BITS, n, len(states), table.check)
    return _HEAD.pack(MAGIC, *fields, zlib.crc32(struct.pack("<6I", *fields))) + b"".join(parts) + stream.tobytes()


def decode(block: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """Tokens ``first`` to ``last`` (all by default); reads only the segments that hold them.

    Raises ``ValueError`` for a damaged block or another table than the encoder's.
    """
    magic, version, lanes, bits, n, segments, check, own = _HEAD.unpack_from(block)
    if magic != MAGIC or version != VERSION or zlib.crc32(struct.pack("<6I", version, lanes, bits, n, segments, check)) != own:
        raise ValueError("not a block of this format, or its header is damaged")
    if check != table.check or bits != SCALE_BITS:
        raise ValueError("the block was encoded with another table")
    last = n if last is None else min(last, n)
    if first >= last:
        return np.empty(0, np.uint32)
    size = 8 + 8 * lanes
    at = _HEAD.size + segments * size
    stream = np.frombuffer(block, "<u4", offset=at)
    per, rows = CHECKPOINT_ROWS * lanes, -(-n // lanes)
    k0, k1 = first // per, (last - 1) // per
    out = np.empty(((k1 - k0 + 1) * CHECKPOINT_ROWS, lanes), np.uint32)
    m, mask, r = np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1), 0
    for k in range(k0, k1 + 1):
        start, crc = struct.unpack_from("<2I", block, _HEAD.size + k * size)
        end = struct.unpack_from("<I", block, _HEAD.size + (k + 1) * size)[0] if k + 1 < segments else len(stream)
        state = block[_HEAD.size + k * size + 8 : _HEAD.size + (k + 1) * size]
        if zlib.crc32(stream[start:end].tobytes(), zlib.crc32(state)) != crc:
            raise ValueError(f"segment {k} is damaged")
        x = np.frombuffer(state, "<u8").astype(np.uint64)
        for _ in range(min(CHECKPOINT_ROWS, rows - k * CHECKPOINT_ROWS)):
            slot = x & mask
            s = table.symbol[slot]
            out[r] = s
            r += 1
            x = table.freq[s] * (x >> m) + slot - table.cum[s]
            low = np.flatnonzero(x < _LOW)
            x[low] = (x[low] << _WORD) | stream[start : start + len(low)]
            start += len(low)
    return out.reshape(-1)[first - k0 * per : last - k0 * per]
