"""A corpus pipeline of the operators of ``gleaner.llm``; each stage's result is written and reread by the next.

All stages keep repeated rows, columns of any name and rows with nulls unless their decision says otherwise: a null or empty
text has the score of the classifier's base rate, is nobody's near copy, is never contaminated, holds no words to be mixed (so
the mix doesn't take it) and is the end id alone in tokens.  A null doc_id is a document of its own, a null source is a
source.  Of ties (ids of a near-copy group) the smallest id stays.  Texts of any length are read whole.  An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, jaccard, mixing, quality, token_output
from gleaner.llm.common import quoted, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels outside the held-out fold, predicts to be good."""
    labels = table(spark, sf_dir, "labels").filter(~quality.held_out(F.col("doc_id"))).select("doc_id", "quality")
    return quality.keep(docs, labels)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles at 0.8 or more."""
    return jaccard.keep_one(docs, jaccard.Similarity(width=5, percent=80))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages cover by less than a twentieth."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix, a document once for each time that it is taken."""
    return mixing.mix(docs).select(*map(quoted, docs.columns))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row of the mix as coded token ids, read back: its place, length and checksum."""
    return token_output.read(spark, token_output.write(docs))


STAGES = [
    ("quality", keep_quality),
    ("near copies", keep_one_of_near_copies),
    ("decontamination", keep_uncontaminated),
    ("mixing", mix_sources),
    ("tokens", encode_tokens),
]

#: A learned model, similarity groups and coded blocks have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
