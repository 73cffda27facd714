"""Chat formatting in budgeted windows of whole turns.

Each turn becomes ``<s>[ROLE role]\\ntext</s>\\n``; control strings inside roles and texts, the template's and the
tokenizer's own, are escaped by a backslash, reversibly.  Prefix sums of the turns' tokens choose the spans: a window takes
as many new turns as fit beside the conversation's system turn, which every later window repeats, and a limited history
(the last turns before the span, within their own budget).  Only new assistant turns are under the loss mask, so a repeated
target is learnt once.  A turn that is too long for any window gets one of its own, whole, marked ``over_budget``.

A conversation is cut into segments of ``Params.segment`` turns by their rank, which are formatted apart: their history and
system turn come from the segments before.  Ranks come from a range-parted order and summed counts of its parts, so a
conversation of any length is spread over tasks, and tasks hold a window at a time.

Edge cases: rows are ordered by turn (null first, any numbers), ties by role and text; a null role or text is empty; texts of
any length stay whole; repeated rows are turns of their own; a null conv_id is a conversation; an empty table gives an
empty result; extra columns, also those named as this module's own, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm.common import small, written
from gleaner.llm.tokens import coder, special_strings

BEGIN, END, ROLE = "<s>", "</s>", "[ROLE "
#: Strings that no text may show as they are: this template's and those of templates it is often mixed with.
CONTROL = (BEGIN, END, ROLE, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Rows of conversations' parts that are sent to every executor at most.
SMALL_PARTS = 500_000

_TURN = re.compile(r"<s>\[ROLE ((?:[^\\\]]|\\.)*)\]\n((?:[^\\<]|\\.|<(?!/s>))*)</s>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


@dataclass(frozen=True)
class Params:
    budget: int = 1024
    history_turns: int = 2
    history_budget: int = 256
    segment: int = 128
    loss_roles: tuple[str, ...] = ("assistant",)
    tokenizer: str = "word_bpe_49k.json"


@cache
def _control(tokenizer: str) -> re.Pattern:
    return re.compile("|".join(map(re.escape, (*CONTROL, *special_strings(tokenizer)))))


def escape(text: str, tokenizer: str = Params.tokenizer) -> str:
    """Backslashes double; a control string gets one behind its first character."""
    return _control(tokenizer).sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_text(role: str, text: str, tokenizer: str = Params.tokenizer) -> tuple[str, int]:
    """The formatted turn, and where its text begins in it."""
    head = f"{BEGIN}{ROLE}{escape(role, tokenizer).replace(']', chr(92) + ']')}]\n"
    return f"{head}{escape(text, tokenizer)}{END}\n", len(head)


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a window."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError("not a formatted window")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


@dataclass
class _Turn:
    role: str
    text: str
    at: int
    tokens: int
    rank: int


class _Segment:
    """Formats the turns of one segment as they come.

    ``sums`` are prefix sums of the new turns' tokens; the open window's span began behind ``sums[first]``."""

    def __init__(self, p: Params):
        self.p, self.system, self.past, self.new, self.window = p, None, [], [], 0
        self.sums, self.first, self.repeated = [0], 0, 0

    def context(self) -> list[_Turn]:
        """The system turn and the history for the next span."""
        own, left = [], self.p.history_budget
        for t in reversed(self.past[-self.p.history_turns :] if self.p.history_turns else []):
            # The next segment gets the system turn by itself; among the last turns of this one it is the same turn.
            if (self.system and t.rank == self.system.rank) or t.tokens > left:
                break
            own.insert(0, t)
            left -= t.tokens
        return ([self.system] if self.system else []) + own

    def add(self, turn: _Turn) -> dict | None:
        """Takes a turn; returns the window that it closes."""
        done = None
        if self.new and self.repeated + self.sums[-1] + turn.tokens - self.sums[self.first] > self.p.budget:
            done = self.close()
        if not self.new:
            self.before = self.context()
            self.repeated, self.first = sum(t.tokens for t in self.before), len(self.sums) - 1
            # History gives way to a span that would not fit beside it, the system turn stays.
            while len(self.before) > bool(self.system) and self.repeated + turn.tokens > self.p.budget:
                self.repeated -= self.before.pop(1 if self.system else 0).tokens
        self.new.append(turn)
        self.sums.append(self.sums[-1] + turn.tokens)
        return done

    def close(self) -> dict:
        parts, spans, at = [], [], 0
        used = self.repeated + self.sums[-1] - self.sums[self.first]
        for k, t in enumerate(self.before + self.new):
            if k >= len(self.before) and t.role in self.p.loss_roles:
                spans.append((at + t.at, at + len(t.text) - len(END) - 1))
            parts.append(t.text)
            at += len(t.text)
        row = {"window": self.window, "text": "".join(parts), "n_new": len(self.new), "n_repeated": len(self.before), "n_tokens": used, "over_budget": used > self.p.budget, "loss": spans}
        for t in self.new:
            self.remember(t)
        self.new, self.window = [], self.window + 1
        return row

    def remember(self, turn: _Turn) -> None:
        self.past = [*self.past, turn][-max(1, self.p.history_turns) :]
        if turn.role == "system" and self.system is None:
            self.system = turn


_WINDOWS = "conv string, segment long, window int, text string, n_new int, n_repeated int, n_tokens long, over_budget boolean, loss array<struct<begin:int,end:int>>"


def _format(p: Params):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, key, segment = coder(p.tokenizer), None, None
        for pdf in batches:
            made = [turn_text(r, t, p.tokenizer) for r, t in zip(pdf["role"], pdf["text"], strict=True)]
            tokens = count.encode([t for t, _ in made])[1]
            out = []

            def put(row):
                if row:
                    out.append({"conv": key[0], "segment": key[1]} | row)

            for conv, seg, kind, rank, role, (text, at), n in zip(pdf["conv"], pdf["segment"], pdf["kind"], pdf["rank"], pdf["role"], made, tokens, strict=True):
                if key != (conv, seg):
                    if segment and segment.new:
                        put(segment.close())
                    key, segment = (conv, seg), _Segment(p)
                turn = _Turn(role, text, at, int(n), int(rank))
                if kind < 2:
                    segment.remember(turn)
                else:
                    put(segment.add(turn))
            if out:
                yield pd.DataFrame(out)
        if segment and segment.new:
            yield pd.DataFrame([{"conv": key[0], "segment": key[1]} | segment.close()])

    return run


def windows(conversations: DataFrame, p: Params = Params()) -> DataFrame:
    """The formatted windows of all conversations (conv_id, turn, role, text): conv (the id's text), segment, window,
    text, n_new, n_repeated, n_tokens, over_budget and the spans of ``text`` under the loss mask."""
    if p.segment <= p.history_turns:
        raise ValueError("a segment must be longer than the history")
    rows = conversations.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # Cuts of the order hold a text's beginning, so that they stay short; the order itself holds all of it.
    ordered = rows.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv", "turn", "role", "text")
    ordered = written(ordered.withColumn("at", F.monotonically_increasing_id()), "turns-in-order")
    # Where each part of the order begins in its conversation.
    parts = ordered.groupBy("conv", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("begin"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv", "part", "begin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy("conv")).alias("all"))
    parts = small(written(parts, "conversation-parts"), SMALL_PARTS).withColumnsRenamed({"conv": "c", "part": "p"})
    same = F.col("conv").eqNullSafe(F.col("c"))
    ranked = ordered.join(parts, same & (F.shiftright("at", 33) == F.col("p"))).withColumn("rank", F.col("at") - F.col("begin") + F.col("offset"))
    segment = F.floor(F.col("rank") / p.segment)
    columns = ["conv", "segment", "kind", "rank", "role", "text"]
    last = F.floor((F.col("all") - 1) / p.segment)
    own = ranked.withColumns({"segment": segment, "kind": F.lit(2)}).select(*columns)
    # The last turns of a full segment are the next one's history.
    tails = ranked.filter((F.col("rank") % p.segment >= p.segment - p.history_turns) & (segment < last)).withColumns({"segment": segment + 1, "kind": F.lit(1)}).select(*columns)
    systems = ranked.filter("role = 'system'").groupBy("conv").agg(F.min(F.struct("rank", "text")).alias("first"), F.max(last).alias("last"))
    later = systems.withColumn("from", F.floor(F.col("first.rank") / p.segment) + 1).filter("last >= `from`").withColumn("segment", F.explode(F.sequence(F.col("from"), F.col("last"))))
    heads = later.select("conv", "segment", F.lit(0).alias("kind"), F.col("first.rank").alias("rank"), F.lit("system").alias("role"), F.col("first.text").alias("text"))
    every = own.unionByName(tails).unionByName(heads).repartition("conv", "segment").sortWithinPartitions("conv", "segment", "kind", "rank")
    return every.mapInPandas(_format(p), _WINDOWS)


_DIGEST = "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    state, key = None, object()

    def row():
        return (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5])

    for pdf in batches:
        out = []
        for conv, text, repeated, loss in zip(pdf["conv"], pdf["text"], pdf["n_repeated"], pdf["loss"], strict=True):
            if state is None or conv != key:
                if state:
                    out.append(row())
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, own in parse(text)[repeated:]:
                state[0] += 1
                state[1].update(f"{role}\n{own}\n".encode("utf-8", "surrogatepass"))
            for span in loss:
                own = unescape(text[span["begin"] : span["end"]])
                state[2] += len(own)
                state[3].update(own.encode("utf-8", "surrogatepass"))
            state[4] += len(text)
            state[5] += 1
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _DIGEST.split(", ")])
    if state:
        yield pd.DataFrame([row()], columns=[c.split()[0] for c in _DIGEST.split(", ")])


def digests(formatted: DataFrame) -> DataFrame:
    """Each conversation read back from its windows: turns, masked text, and sizes.

    A digest of a whole conversation is a chain, so its windows stream through one task in order, one at a time.
    """
    rows = formatted.select("conv", "segment", "window", "text", "n_repeated", "loss")
    return rows.repartition("conv").sortWithinPartitions("conv", "segment", "window").mapInPandas(_digests, _DIGEST)
