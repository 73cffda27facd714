"""Token ids of a public tokenizer file, with bounded memos of white-space-parted chunks and their pieces."""

from __future__ import annotations

import gc
import json
import os
import re
from itertools import chain, compress, groupby, repeat

import numpy as np
import pyarrow as pa
import regex


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer file by its name; a path stays as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def special_strings(name: str) -> list[str]:
    """The strings that a tokenizer file reads as tokens of their own."""
    with open(tokenizer_file(name), encoding="utf-8") as f:
        return [t["content"] for t in json.load(f).get("added_tokens", [])]


#: Chunks of these characters are the same under NFC, have one-to-one lower cases, no white space and no "<", with
#: which special tokens begin.
_PLAIN = re.compile("[\x21-;=-\x7e¡-įı-ɏ]*")
#: Texts of such chunks and ASCII spaces: they are lower-cased at once.
_PLAIN_TEXT = re.compile("[\x20-;=-\x7e¡-įı-ɏ]*")


def is_plain(text: str) -> bool:
    """Whether a text has only characters of ``_PLAIN`` and spaces; first by what C code tells fast."""
    if "<" in text:
        return False
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return _PLAIN_TEXT.fullmatch(text) is not None
    return text.isprintable()


def byte_characters() -> list[str]:
    """The printable character that byte-level tokenizers write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


#: The pre-token pattern that pieces are cut by: a fixed value of the tokenizer's file.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_APOSTROPHE = ord("'")
_LETTER, _NUMBER, _OTHER = 1, 2, 3
#: The kind of each character of plain texts; 0 is a space.
_KINDS = np.array([0 if k <= 0x20 else _LETTER if regex.match(r"\p{L}", chr(k)) else _NUMBER if regex.match(r"\p{N}", chr(k)) else _OTHER for k in range(0x250)], np.uint8)


def piece_starts(code: np.ndarray) -> np.ndarray:
    """Whether a piece of ``PIECES`` begins at each character of a plain text, which ends with three spaces."""
    kind = _KINDS[code]
    start = kind > 0
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    # A contraction is a piece if no run of other marks has taken its apostrophe.
    at = np.flatnonzero((code == _APOSTROPHE) & start)
    if len(at):
        first, second = code[at + 1], code[at + 2]
        short = np.isin(first, np.frombuffer(b"stmd", np.uint8))
        long = ((second == ord("e")) & ((first == ord("r")) | (first == ord("v")))) | ((first == ord("l")) & (second == ord("l")))
        for own, size in ((at[short], 2), (at[long], 3)):
            start[own + 1] = False
            behind = own + size
            start[behind[kind[behind] == _LETTER]] = True
    return start


class ChunkTokenizer:
    """Encodes whole texts with a tokenizer that drops white space.

    No token, merge or normalisation of such a tokenizer reaches across an ASCII space, tab, line feed or
    carriage return, so a text's ids are those of its chunks in order, and a chunk's those of its pre-token
    pieces.  Texts of plain Latin characters are cut into pieces at once, over arrays of characters; Arrow finds
    the distinct ones, and the library's model merges each of them once.  Other texts are cut chunk by chunk, and
    chunks that aren't plain, or hold a special token's string, are left to the library whole.
    Pieces and such chunks are kept in one memo of bounded size: once it holds ``most`` entries it is cut back to
    those used most, of late above all.
    """

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = tokenizer_file(path)
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        steps = own["pre_tokenizer"]["pretokenizers"] if own["pre_tokenizer"]["type"] == "Sequence" else []
        forms = [n["type"] for n in (own.get("normalizer") or {}).get("normalizers", [])]
        if [s["type"] for s in steps] != ["Split", "ByteLevel"] or not steps[0]["invert"] or steps[0]["behavior"] != "Removed" or forms != ["NFC", "Replace", "Lowercase"] or steps[0]["pattern"]["Regex"] != PIECES:
            raise ValueError("chunks can be encoded apart only for a lower-casing tokenizer that drops white space and cuts the known pieces")
        if not all(t["content"].startswith("<") for t in own["added_tokens"]):
            raise ValueError("a special token doesn't begin with '<'")
        self._tokenizer = Tokenizer.from_file(path)
        #: One more than the largest id.
        self.size = max(self._tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self._merge = self._tokenizer.model.tokenize
        self._pieces = regex.compile(PIECES).findall
        self._bytes = dict(enumerate(byte_characters()))
        self._most = most
        self._clear()

    def _clear(self) -> None:
        # An entry's place in the index's order is its place in the arrays.
        self._index = {"": 0}
        self._start, self._len, self._uses, self._used = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int64), 1
        self._pool, self._filled = np.zeros(1 << 16, np.uint32), 0

    def rest(self, keep: int = 60_000) -> None:
        """Cuts the memo back between tasks: workers are kept, and other work needs their memory."""
        if len(self._index) > keep:
            self._cut(keep)

    def _cut(self, keep: int) -> None:
        uses = self._uses[: self._used]
        uses[0] = uses.max() + 1  # the empty chunk stays in its place
        often = np.sort(np.argpartition(-uses, keep - 1)[:keep])
        stays = np.zeros(self._used, bool)
        stays[often] = True
        self._index = dict(zip(compress(self._index, stays.tolist()), range(keep), strict=True))
        lens = self._len[often]
        ends = np.cumsum(lens, dtype=np.int64)
        self._pool = np.concatenate([self._pool[self._spread(self._start[often], lens, ends)], np.zeros(max(1 << 16, int(ends[-1])), np.uint32)])
        self._filled, self._used = int(ends[-1]), keep
        self._len, self._start, self._uses = lens, (ends - lens).astype(np.int32), uses[often] // 2

    @staticmethod
    def _spread(start: np.ndarray, lens: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The places ``start`` to ``start + lens`` of all runs; ``ends`` are the summed lengths."""
        at = np.repeat(start - (ends - lens).astype(np.int32), lens)
        at += np.arange(len(at), dtype=np.int32)
        return at

    def _store(self, keys: list[str], ids: list[list[int]]) -> None:
        lens = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lens.sum()))
        while self._filled + len(flat) > len(self._pool):
            self._pool = np.concatenate([self._pool, np.zeros_like(self._pool)])
        self._pool[self._filled : self._filled + len(flat)] = flat
        while self._used + len(lens) > len(self._len):
            self._len, self._start, self._uses = (np.concatenate([a, np.zeros_like(a)]) for a in (self._len, self._start, self._uses))
        at = slice(self._used, self._used + len(lens))
        self._len[at], self._start[at] = lens, self._filled + np.cumsum(lens) - lens
        self._index.update(zip(keys, range(self._used, self._used + len(keys)), strict=True))
        self._used += len(lens)
        self._filled += len(flat)

    def _learn(self, missing: list[str], plain: bool) -> None:
        """Adds pieces, and where not all are ``plain`` whole chunks, to the memo."""
        merge, table, ids = self._merge, self._bytes, []
        hard = [] if plain else [k for k, w in enumerate(missing) if not _PLAIN.fullmatch(w)]
        whole = dict(zip(hard, self._tokenizer.encode_batch([missing[k] for k in hard], add_special_tokens=False), strict=True)) if hard else {}
        for k, w in enumerate(missing):
            if k in whole:
                ids.append(whole[k].ids)
            else:
                ids.append([t.id for t in merge(w if w.isascii() else w.encode().decode("latin-1").translate(table))])
        self._store(missing, ids)

    def _looked_up(self, units: pa.Array, plain: bool) -> np.ndarray:
        """The memo's place of every unit."""
        coded = units.dictionary_encode()
        distinct, own = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        get = self._index.get
        places = np.fromiter(map(get, distinct, repeat(-1)), np.int32, len(distinct))
        new = np.flatnonzero(places < 0)
        if len(new):
            places[new] = np.arange(self._used, self._used + len(new))
            self._learn([distinct[k] for k in new.tolist()], plain)
        self._uses[places] += np.bincount(own, minlength=len(places))
        return places[own]

    def _plain_units(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The pieces of plain texts, and how many each text has."""
        joined = " ".join(map(str.lower, texts)) + "   "
        data = joined.encode()
        whole = len(data) == len(joined)
        code = np.frombuffer(data, np.uint8) if whole else np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        at = np.flatnonzero(piece_starts(code))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        n = np.diff(np.searchsorted(at, np.cumsum(sizes), side="left"), prepend=0)
        data = np.frombuffer(data, np.uint8)
        # Offsets of pieces in the text's bytes without its spaces.
        ends = np.cumsum(code != 0x20, dtype=np.int64) if whole else np.cumsum((code != 0x20) + (code >= 0x80).astype(np.int8), dtype=np.int64)
        total = int(ends[-1])
        offsets = np.append(ends[at] - (1 if whole else 1 + (code[at] >= 0x80)), total)
        packed = data[data != 0x20]
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(packed)]), n

    def _other_units(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The pieces of plain chunks and whole other chunks, and how many of them each text has."""
        plain, pieces, units, n = _PLAIN.fullmatch, self._pieces, [], []
        for t in texts:
            before = len(units)
            for w in filter(None, t.split(" ")):
                if plain(w):
                    units += pieces(w.lower())
                else:
                    units.append(w)
            n.append(len(units) - before)
        return pa.array(units, pa.large_string()), np.array(n, np.int64)

    def _ids(self, texts: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        units, sizes = self._plain_units(texts) if plain else self._other_units(texts)
        idx = self._looked_up(units, plain)
        lens = self._len[idx]
        ends = np.cumsum(lens, dtype=np.int64)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        return self._pool[self._spread(self._start[idx], lens, ends)], np.diff(bounds)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids after one another, and how many each text has."""
        collects = gc.isenabled()
        gc.disable()  # this makes many small lists and no cycles; looking for some costs a tenth of the time
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self._index) > self._most:
            self._cut(self._most // 2)
        texts = [(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ") for t in texts]
        plain = list(map(is_plain, texts))
        if all(plain):
            return self._ids(texts, True)
        out = []  # runs of texts of one kind
        for kind, run in groupby(zip(plain, texts, strict=True), key=lambda x: x[0]):
            out.append(self._ids([t for _, t in run], kind))
        return np.concatenate([ids for ids, _ in out]), np.concatenate([n for _, n in out])


_coders: dict[str, ChunkTokenizer] = {}


def coder(path: str) -> ChunkTokenizer:
    """This process's tokenizer, with what it has learnt in earlier tasks."""
    if path not in _coders:
        _coders[path] = ChunkTokenizer(path)
    return _coders[path]
