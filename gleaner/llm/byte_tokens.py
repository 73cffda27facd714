"""Token ids of a byte-level tokenizer, with the bounded memo of :mod:`gleaner.llm.tokens` over pre-tokens.

A byte-level tokenizer encodes each match of its pattern on its own.  Texts of Latin characters are cut into matches over arrays
of characters, other texts of well-known scripts by the pattern; texts that hold a special token's string, other control
characters or other scripts (where libraries may differ on what a letter is) are left to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex

from gleaner.llm.edit_counts import PATTERN
from gleaner.llm.tokens import ChunkTokenizer, byte_characters, tokenizer_file

_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ɏ]*")
#: Latin, Greek, Cyrillic and common punctuation: what they are hasn't changed between versions of Unicode.
_KNOWN = re.compile("[\t\n\r\x20-\x7e\xa0-ͯΆ-ҁҊ-ԥ‐-‧‰-⁞€]*")
_END, _SPACE, _GAP, _LETTER, _NUMBER, _OTHER = range(6)
_WHOLE, _PIECES, _ARRAYS = range(3)


def _kind(k: int) -> int:
    if k in (0, 0x20) or chr(k) in "\t\n\r":
        return {0: _END, 0x20: _SPACE}.get(k, _GAP)
    return _LETTER if regex.match(r"\p{L}", chr(k)) else _NUMBER if regex.match(r"\p{N}", chr(k)) else _OTHER


_KINDS = np.array([_kind(k) for k in range(0x250)], np.uint8)


def match_starts(code: np.ndarray) -> np.ndarray:
    """Whether a match of ``PATTERN`` begins at each character of plain texts, each of which ends with a zero; three zeros end all."""
    kind = _KINDS[code]
    before, behind = np.concatenate([[_END], kind[:-1]]), np.concatenate([kind[1:], [_END]])
    gap, gap_before = (kind == _SPACE) | (kind == _GAP), (before == _SPACE) | (before == _GAP)
    # The last of several white spaces before a word is left out of their match; a space then goes with the word.
    start = (gap & (~gap_before | (behind >= _LETTER))) | ((kind >= _LETTER) & (kind != before) & (before != _SPACE))
    at = np.flatnonzero((code == ord("'")) & start)
    if len(at):
        first, second = code[at + 1], code[at + 2]
        short = np.isin(first, np.frombuffer(b"stmd", np.uint8))
        long = ((second == ord("e")) & ((first == ord("r")) | (first == ord("v")))) | ((first == ord("l")) & (second == ord("l")))
        for own, size in ((at[short], 2), (at[long], 3)):
            start[own + 1] = False
            then = own + size
            start[then[kind[then] == _LETTER]] = True
    return start


class ByteTokenizer(ChunkTokenizer):
    """Encodes whole texts as the library does with ``add_special_tokens=False``."""

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = tokenizer_file(path)
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        cuts = own["pre_tokenizer"]
        if own.get("normalizer") or cuts["type"] != "ByteLevel" or cuts["add_prefix_space"] or not cuts.get("use_regex", True):
            raise ValueError("matches can be encoded apart only for a byte-level tokenizer of the known pattern")
        self._special = [t["content"] for t in own["added_tokens"]]
        self._tokenizer = Tokenizer.from_file(path)
        self.size = max(self._tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self._merge = self._tokenizer.model.tokenize
        self._pieces = regex.compile(PATTERN).findall
        self._bytes = dict(enumerate(byte_characters()))
        self._most = most
        self._clear()

    def _learn(self, missing: list[str], plain: bool) -> None:
        merge, table = self._merge, self._bytes
        self._store(missing, [[t.id for t in merge(w.encode().decode("latin-1").translate(table))] for w in missing])

    def _plain_units(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        joined = "\0".join(texts) + "\0\0\0"
        data = joined.encode()
        whole = len(data) == len(joined)
        code = np.frombuffer(data, np.uint8) if whole else np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        at = np.flatnonzero(match_starts(code))
        n = np.diff(np.searchsorted(at, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1), side="left"), prepend=0)
        width = (code != 0).astype(np.int8) + (code >= 0x80)
        ends = np.cumsum(width, dtype=np.int64)
        offsets = np.append(ends[at] - width[at], ends[-1]).astype(np.int64)
        data = np.frombuffer(data, np.uint8)
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[data != 0])]), n

    def _other_units(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        units = [self._pieces(t) for t in texts]
        return pa.array([p for own in units for p in own], pa.large_string()), np.fromiter(map(len, units), np.int64, len(units))

    def _way(self, text: str) -> int:
        if any(s in text for s in self._special):
            return _WHOLE
        return _ARRAYS if _PLAIN.fullmatch(text) else _PIECES if _KNOWN.fullmatch(text) else _WHOLE

    def _encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self._index) > self._most:
            self._cut(self._most // 2)
        out = [(np.zeros(0, np.uint32), np.zeros(0, np.int64))]
        for way, run in groupby([t or "" for t in texts], key=self._way):
            own = list(run)
            if way == _WHOLE:
                found = [e.ids for e in self._tokenizer.encode_batch(own, add_special_tokens=False)]
                out.append((np.array([k for ids in found for k in ids], np.uint32), np.fromiter(map(len, found), np.int64, len(found))))
            else:
                out.append(self._ids(own, way == _ARRAYS))
        return np.concatenate([ids for ids, _ in out]), np.concatenate([n for _, n in out])


_coders: dict[str, ByteTokenizer] = {}


def coder(path: str) -> ByteTokenizer:
    """This process's tokenizer, with what it has learnt in earlier tasks."""
    if path not in _coders:
        _coders[path] = ByteTokenizer(path)
    return _coders[path]
