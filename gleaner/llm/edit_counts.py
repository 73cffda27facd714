"""Edit-aware token counts: a segment tree over a document's pre-tokens, re-encoding only what edits touch.

A byte-level tokenizer encodes each pre-token (a match of its pattern) on its own, so a document's count is the sum over
its pre-tokens.  ``TokenTree`` keeps them in leaves of about ``LEAF`` under a binary tree of sums of characters and
tokens.  An edit descends by characters to the pre-tokens it touches, goes back two (the pattern looks ahead by two
characters at most), and matches anew until a match ends where an old one did, clear of the context's end; only the new
matches are counted, and the sums above the changed leaves are updated.

``plant`` stores the trees of all documents, their pre-tokens' lengths and counts beside the text; ``edit`` applies a batch of
edits to stored trees and returns trees, so any number of batches encode only what they touch.  ``count`` does both at once.

Edge cases: null and empty texts count 0; the strings of special tokens are ordinary text and are encoded as such; edits are
applied in order, positions are code points and are cut to the text; null parts of an edit are 0 or empty, and null lists of
edits are none; texts of any length stay whole; repeated and null ids are rows of their own (all rows of an id get the id's
edits, a null id has none); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.tokens import byte_characters, tokenizer_file

TOKENIZER = "byte_bpe_50k.json"
LEAF, CONTEXT, MEMO = 64, 2, 250_000
#: The pre-token pattern of byte-level tokenizers: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_pieces = regex.compile(PATTERN).findall


class PieceCounter:
    """Tokens of a pre-token, memoized within a bound."""

    def __init__(self, tokenizer: str = TOKENIZER):
        from tokenizers import Tokenizer

        self._merge = Tokenizer.from_file(tokenizer_file(tokenizer)).model.tokenize
        self._bytes = byte_characters()
        self._memo: dict[str, int] = {}

    def __call__(self, pieces: list[str]) -> list[int]:
        memo = self._memo
        if len(memo) > MEMO:
            memo.clear()
        for p in set(pieces).difference(memo):
            memo[p] = len(self._merge("".join(map(self._bytes.__getitem__, p.encode("utf-8", "surrogatepass")))))
        return [memo[p] for p in pieces]


class TokenTree:
    """``tokens`` is the count of the current text; ``encoded`` how many pre-tokens have been counted in all."""

    def __init__(self, text: str, counter: PieceCounter):
        self._counter = counter
        self.encoded = 0
        self._plant(_pieces(text))

    @classmethod
    def load(cls, text: str, lengths: bytes, counts: bytes, counter: PieceCounter) -> TokenTree:
        """The tree that ``dump`` wrote beside its text; nothing is encoded."""
        self = cls.__new__(cls)
        self._counter, self.encoded = counter, 0
        ends = np.cumsum(np.frombuffer(lengths, "<u4"), dtype=np.int64).tolist()
        self._hang([text[a:b] for a, b in zip([0, *ends], ends, strict=False)], np.frombuffer(counts, "<u4").tolist())
        return self

    def dump(self) -> tuple[bytes, bytes]:
        """The lengths and counts of all pre-tokens."""
        pieces, counts = ([x for own in kind for x in own] for kind in (self._leaves, self._counts))
        return np.fromiter(map(len, pieces), "<u4", len(pieces)).tobytes(), np.array(counts, "<u4").tobytes()

    def _plant(self, pieces: list[str]) -> None:
        self.encoded += len(pieces)
        self._hang(pieces, self._counter(pieces))

    def _hang(self, pieces: list[str], counts: list[int]) -> None:
        self._leaves = [pieces[k : k + LEAF] for k in range(0, len(pieces), LEAF)] or [[]]
        self._counts = [counts[k : k + LEAF] for k in range(0, len(pieces), LEAF)] or [[]]
        self._grow()

    def _grow(self) -> None:
        self._base = 1 << max(0, (len(self._leaves) - 1).bit_length())
        self._chars, self._tokens = [0] * (2 * self._base), [0] * (2 * self._base)
        for k, (own, n) in enumerate(zip(self._leaves, self._counts, strict=True)):
            self._chars[self._base + k], self._tokens[self._base + k] = sum(map(len, own)), sum(n)
        for k in range(self._base - 1, 0, -1):
            for tree in (self._chars, self._tokens):
                tree[k] = tree[2 * k] + tree[2 * k + 1]

    @property
    def tokens(self) -> int:
        return self._tokens[1]

    @property
    def chars(self) -> int:
        return self._chars[1]

    @property
    def pieces(self) -> int:
        return sum(map(len, self._leaves))

    def text(self) -> str:
        return "".join(p for own in self._leaves for p in own)

    def _find(self, pos: int) -> tuple[int, int]:
        """The leaf that holds a position, and the leaf's first position."""
        k, before = 1, 0
        while k < self._base:
            k *= 2
            if pos >= before + self._chars[k] and k + 1 < 2 * self._base and self._chars[k + 1]:
                before += self._chars[k]
                k += 1
        return min(k - self._base, len(self._leaves) - 1), before

    def edit(self, pos: int, delete: int, insert: str) -> None:
        pos = min(max(pos, 0), self.chars)
        end = min(pos + max(delete, 0), self.chars)
        first, before = self._find(max(pos - 1, 0))
        last, _ = self._find(end)
        if first and pos - before <= 2 * CONTEXT * 2:  # pre-tokens before the edit may lie in the leaf before
            first -= 1
            before -= sum(map(len, self._leaves[first]))
        extra = 1
        while True:
            last = min(last, len(self._leaves) - 1)
            old = [p for own in self._leaves[first : last + 1] for p in own]
            ends = list(accumulate(map(len, old)))
            skip = max(0, next((k for k, e in enumerate(ends) if before + e >= pos), len(old)) - CONTEXT)
            at = before + (ends[skip - 1] if skip else 0)
            joined = "".join(old[skip:])
            changed = joined[: pos - at] + insert + joined[end - at :]
            made, whole = _pieces(changed), last == len(self._leaves) - 1
            cut = self._meet(made, ends[skip:], at - before, pos - at + len(insert), len(insert) - (end - pos), len(changed), whole)
            if cut:
                break
            last, extra = last + extra, extra * 2
        n_new, n_old = cut
        fresh = self._counter(made[:n_new])
        self.encoded += n_new
        counts = [c for own in self._counts[first : last + 1] for c in own]
        self._replace(first, last, old[:skip] + made[:n_new] + old[skip + n_old :], counts[:skip] + fresh + counts[skip + n_old :])

    @staticmethod
    def _meet(made: list[str], ends: list[int], shift: int, touched: int, moved: int, size: int, whole: bool) -> tuple[int, int] | None:
        """How many new and old pre-tokens to exchange: up to a common end behind the edit and clear of the context's
        end; all, where the context ends with the text; None if there is no such end."""
        old = {e - shift + moved: k + 1 for k, e in enumerate(ends)}
        at = 0
        for k, p in enumerate(made):
            at += len(p)
            if at >= touched and at in old and at <= size - 2 * CONTEXT:
                return k + 1, old[at]
        return (len(made), len(ends)) if whole else None

    def _replace(self, first: int, last: int, pieces: list[str], counts: list[int]) -> None:
        """The leaves keep their number while they can hold the pre-tokens; else the tree is planted anew from its parts."""
        room = last - first + 1
        each = -(-len(pieces) // room)
        if each > 4 * LEAF:
            self._leaves[first : last + 1] = [pieces[k : k + LEAF] for k in range(0, len(pieces), LEAF)]
            self._counts[first : last + 1] = [counts[k : k + LEAF] for k in range(0, len(pieces), LEAF)]
            self._grow()
            return
        for k in range(room):
            own, n = pieces[k * each : (k + 1) * each], counts[k * each : (k + 1) * each]
            self._leaves[first + k], self._counts[first + k] = own, n
            i = self._base + first + k
            self._chars[i], self._tokens[i] = sum(map(len, own)), sum(n)
        low, high = self._base + first, self._base + last
        while low > 1:
            low, high = low // 2, high // 2
            for i in range(low, high + 1):
                for tree in (self._chars, self._tokens):
                    tree[i] = tree[2 * i] + tree[2 * i + 1]


def _whole(x) -> int:
    """A number in a pandas row; null, however it is written there, is 0."""
    return 0 if x is None or x != x else int(x)


_counters: dict[str, PieceCounter] = {}


def _counter(tokenizer: str) -> PieceCounter:
    if tokenizer not in _counters:
        _counters[tokenizer] = PieceCounter(tokenizer)
    return _counters[tokenizer]


def _edit(tree: TokenTree, edits) -> None:
    for e in edits if edits is not None else ():
        if e is not None:
            tree.edit(_whole(e["pos"]), _whole(e["n_delete"]), e["insert"] or "")


def _run(tokenizer: str, columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(tokenizer)
        for pdf in batches:
            rows = []
            for text, edits in zip(pdf["text"], pdf["edits"], strict=True):
                tree = TokenTree(text or "", counter)
                before, planted = tree.tokens, tree.encoded
                _edit(tree, edits)
                rows.append((before, tree.tokens, planted, tree.encoded - planted))
            done = pd.DataFrame(rows, columns=["n_tokens", "n_tokens_edited", "n_pretokens", "n_reencoded"])
            yield pd.concat([pdf[columns].reset_index(drop=True), done], axis=1)

    return run


def _trees(tokenizer: str, stored: bool):
    names = ["doc_id", "text", "lengths", "counts", "n_tokens", "n_encoded"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(tokenizer)
        for pdf in batches:
            for r in pdf.itertuples(index=False):  # a row at a time: texts and trees can be long
                if stored:
                    tree = TokenTree.load(r.text, r.lengths, r.counts, counter)
                    _edit(tree, r.edits)
                else:
                    tree = TokenTree(r.text or "", counter)
                yield pd.DataFrame([(r.doc_id, tree.text(), *tree.dump(), tree.tokens, tree.encoded)], columns=names)

    return run


_TREES = "doc_id string, text string, lengths binary, counts binary, n_tokens long, n_encoded long"


def plant(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """The trees of ``docs`` (doc_id, text) as rows to be stored: doc_id (as text), text, lengths and counts of its pre-tokens,
    n_tokens, and n_encoded, how many pre-tokens were counted for it."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(_trees(tokenizer, False), _TREES)


def edit(trees: DataFrame, edits: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Stored ``trees`` after a batch of ``edits`` (as for ``with_edits``); only what the edits touch is encoded."""
    own = with_edits(trees.select("doc_id", "text", "lengths", "counts"), edits.withColumn("doc_id", F.col("doc_id").cast("string")))
    return own.mapInPandas(_trees(tokenizer, True), _TREES)


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` with the list ``edits`` of each document, from rows (doc_id, edit_no, pos, n_delete, insert) in the order
    of edit_no; ties by place and text."""
    one = F.struct("edit_no", F.col("pos").cast("long").alias("pos"), F.col("n_delete").cast("long").alias("n_delete"), "insert")
    lists = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("edits"))
    lists = lists.select("doc_id", F.transform("edits", lambda e: F.struct(e["pos"].alias("pos"), e["n_delete"].alias("n_delete"), e["insert"].alias("insert"))).alias("edits"))
    return docs.join(lists, "doc_id", "left")


def count(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited (after ``edits``), n_pretokens and n_reencoded of ``docs`` (doc_id, text, edits)."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "edits")
    out = rows.mapInPandas(_run(tokenizer, ["doc_id"]), "doc_id string, n_tokens long, n_tokens_edited long, n_pretokens long, n_reencoded long")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
