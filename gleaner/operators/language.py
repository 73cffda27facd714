"""The language of texts from profiles of character n-grams, learned by an aggregation and scored in one pass.

``learn`` counts the n-grams of texts whose language is known, combined in each batch before the shuffle, and keeps the
``most`` commonest of each language: the profile is as large as languages times ``most``, whatever the corpus.  ``detect``
gives the language under which a text's n-grams are likeliest, with add-one smoothing over the union of the profiles.

Edge cases: rows without text or language teach nothing; null and empty texts, and texts none of whose n-grams is in any
profile, have no language; ties go to the first language in order; other columns are kept by ``detect``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

N, MOST, MOST_LANGUAGES = 3, 3_000, 400


def _grams(text: str, n: int) -> Counter:
    padded = f" {text.lower()} "
    return Counter(map("".join, zip(*(padded[k:] for k in range(n)), strict=False)))


def _count(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts: dict[str, Counter] = {}
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                counts.setdefault(lang, Counter()).update(_grams(text, n))
            rows = [(lang, g, c) for lang, own in counts.items() for g, c in own.items()]
            yield pd.DataFrame(rows, columns=["lang", "gram", "n"]).astype({"n": "int64"})

    return run


def learn(df: DataFrame, text: str, lang: str, n: int = N, most: int = MOST) -> DataFrame:
    """lang, gram, n and total (n-grams of the language) of the profiles."""
    known = df.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).filter("lang <> '' AND text <> ''")
    counts = known.mapInPandas(_count(n), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank").join(totals, "lang")


class Detector:
    """Profiles in memory: a row of log likelihoods for each n-gram of their union."""

    def __init__(self, profiles: DataFrame, n: int = N):
        rows = profiles.limit(MOST * MOST_LANGUAGES + 1).collect()
        if len(rows) > MOST * MOST_LANGUAGES:
            raise ValueError(f"profiles of more than {MOST * MOST_LANGUAGES} n-grams")
        self.n, self.langs = n, sorted({r.lang for r in rows})
        self.at = {g: k for k, g in enumerate(sorted({r.gram for r in rows}))}
        column = {x: k for k, x in enumerate(self.langs)}
        counts, totals = np.zeros((len(self.at), len(self.langs))), np.zeros(len(self.langs))
        for r in rows:
            counts[self.at[r.gram], column[r.lang]] = r.n
            totals[column[r.lang]] = r.total
        self.logs = np.log(counts + 1) - np.log(totals + max(1, len(self.at)))

    def best(self, text: str | None) -> str | None:
        own = [(self.at[g], c) for g, c in _grams(text, self.n).items() if g in self.at] if text else []
        if not own:
            return None
        rows, times = zip(*own, strict=True)
        return self.langs[int(np.argmax(np.array(times) @ self.logs[list(rows)]))]


def detect(text: Column, detector: Detector) -> Column:
    """The language of a text."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([detector.best(t) for t in texts], dtype=object)

    return run(text)


def filled_language(known: Column, text: Column, detector: Detector) -> Column:
    """The language that is known, else English for an empty text, else what is detected, else English."""
    given = F.when(F.trim(known) != "", known)
    return F.coalesce(given, F.when(F.trim(F.coalesce(text, F.lit(""))) != "", detect(text, detector)), F.lit("en"))
