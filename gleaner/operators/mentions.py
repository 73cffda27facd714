"""Many names at once: every occurrence of any name in every text, by one automaton and one pass over the texts.

Names and texts are compared without regard to case.  An occurrence is bounded by words: beside an edge of the name that is a
letter, a digit or an underscore there is no other such character.  Occurrences that overlap count each.

A task builds the automaton of a block of names; names of more than ``block_chars`` characters in all are cut into blocks by
hash, each with a pass of its own, so neither driver nor tasks hold more, however many names there are.  Texts aren't shuffled.

Edge cases: null and empty names are none, names that differ in case only are one; null and empty texts hold none; rows that
are repeated give repeated results; no names or no texts give no rows; other columns than the key are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.storage import Steps, bound_batches

BLOCK_CHARS = 4_000_000


def _inside(c: str) -> bool:
    return c.isalnum() or c == "_"


def _count(found: ahocorasick.Automaton, text: str) -> Counter:
    """How often each name occurs between bounds."""
    out: Counter = Counter()
    for end, name in found.iter(text):
        start, after = end - len(name) + 1, end + 1
        if start and _inside(name[0]) and _inside(text[start - 1]):
            continue
        if after < len(text) and _inside(name[-1]) and _inside(text[after]):
            continue
        out[name] += 1
    return out


def _search(names: Broadcast):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = ahocorasick.Automaton()
        for n in names.value:
            found.add_word(n, n)
        found.make_automaton()
        for pdf in batches:
            hits = [(key, name, n) for key, text in zip(pdf["key"], pdf["low"], strict=True) for name, n in sorted(_count(found, text).items())]
            yield pd.DataFrame(hits, columns=["key", "name", "n"]).astype({"name": object, "n": "int64"})

    return run


def count_mentions(df: DataFrame, key: str, text: str, names: DataFrame, name: str = "name", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``key`` (not null), name (lower case) and n, the occurrences of each name that a row's text holds."""
    spark = df.sparkSession
    kind = df.schema[key].dataType
    bound_batches(spark)
    steps = Steps(spark, "mentions")
    low = F.lower(F.col(f"`{name}`").cast("string"))
    own = steps.written(names.select(low.alias("name")).filter("name <> ''").distinct())
    blocks = -(-(own.agg(F.sum(F.length("name") + 1)).head()[0] or 0) // block_chars)
    rows = df.select(F.col(f"`{key}`").alias("key"), F.lower(F.col(f"`{text}`")).alias("low")).filter("key IS NOT NULL AND low <> ''")
    out = spark.createDataFrame([], f"key {kind.simpleString()}, name string, n long")
    for b in range(blocks):
        block = own.filter(F.pmod(F.xxhash64("name"), F.lit(blocks)) == b)
        held = spark.sparkContext.broadcast([r.name for r in block.toLocalIterator()])
        if held.value:
            out = out.unionByName(rows.mapInPandas(_search(held), out.schema))
    return out.withColumnRenamed("key", key)
