"""Minimal perfect hashing of distinct 64-bit keys, by levels of bits (built and probed in numpy)."""

from __future__ import annotations

import struct

import numpy as np

from gleaner.llm.common import mix64

_GAMMA, _LEVELS = 2.0, 64


class PerfectHash:
    """Maps each of ``n`` distinct keys to a number below ``n`` of its own; other keys to any number or -1.

    A level holds a bit for each slot that exactly one of its keys hashes to; keys that clash go on to the
    next level.  A key's number is the count of set bits before its own.  About 3 bits a key, ranks included.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self._ranks, before = [], 0
        for bits in levels:
            ends = np.cumsum(np.bitwise_count(bits).astype(np.int64))
            self._ranks.append(before + ends - np.bitwise_count(bits))
            before += int(ends[-1]) if len(ends) else 0
        self.n = before

    @staticmethod
    def _slots(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        return mix64(keys + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(words * 64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], np.asarray(keys, np.uint64)
        for level in range(_LEVELS):
            if not len(left):
                return cls(levels)
            words = max(1, int(-(-len(left) * _GAMMA // 64)))
            slots = cls._slots(left, level, words)
            alone = np.bincount(slots.astype(np.int64), minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[slots]]
        raise ValueError("the keys aren't distinct")

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, np.uint64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self._ranks, strict=True)):
            if not len(open_):
                break
            slots = self._slots(keys[open_], level, len(bits))
            word, bit = (slots >> np.uint64(6)).astype(np.int64), slots & np.uint64(63)
            own = bits[word]
            hit = (own >> bit) & np.uint64(1) == 1
            below = own & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (ranks[word] + np.bitwise_count(below))[hit]
            open_ = open_[~hit]
        return out

    def dump(self) -> bytes:
        return struct.pack(f"<{1 + len(self.levels)}I", len(self.levels), *map(len, self.levels)) + b"".join(x.tobytes() for x in self.levels)

    @classmethod
    def load(cls, data: bytes) -> tuple[PerfectHash, int]:
        """The hash and how many bytes it took."""
        (n,) = struct.unpack_from("<I", data)
        sizes, at, levels = struct.unpack_from(f"<{n}I", data, 4), 4 + 4 * n, []
        for size in sizes:
            levels.append(np.frombuffer(data, "<u8", size, at))
            at += 8 * size
        return cls(levels), at
