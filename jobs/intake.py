"""Incremental intake of texts: new files are cleaned, repeats are told apart, and what stays is cut into tagged insights.

    spark-submit jobs/intake.py --config jobs/intake.json

Every run takes the files that came since the last one (a file stream with a checkpoint, until all are read) and writes, a
folder for each batch:

* ``decisions/batch=N/decision=...``: a row for each document: kept, repeated, or why it was dropped; texts of kept ones only
* ``insights/batch=N/source_name=...``: the sentences of kept documents with sentiment, intent and numbers
* ``counts/batch=N``: documents and characters by source and decision, which all runs' ``report`` is summed from

A batch that runs again, after a failure between its writes, overwrites its own folders, so nothing is doubled.  A text that an
earlier batch kept is a repeat; within a batch the smallest doc_id is kept.  Rows that repeat id and text are one document; a
row without an id is dropped as ``no_id``; a null text is an empty one; a blank language is ``en``.
"""

from __future__ import annotations

import logging
import os
import sys
from dataclasses import dataclass

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import first_filled
from gleaner.models import rule_tag
from gleaner.operators.chunks import sentences
from gleaner.operators.cleaning import page_drop
from jobs.common import main

log = logging.getLogger("gleaner.jobs.intake")

DOCUMENTS = "doc_id long, text string, lang string, source string"
DECISIONS = "doc_id long, source string, language string, digest binary, n_chars int, text string, batch long, decision string"
INSIGHTS = "doc_id long, n int, text string, sentiment string, intent string, numbers array<string>, source string, language string, batch long, source_name string"
COUNTS = "source string, decision string, n_documents long, n_chars long, batch long"


@dataclass(frozen=True)
class Settings:
    """``input`` is a folder of Parquet files (or a pattern of files); the others are folders of the job's own."""

    input: str
    output: str
    checkpoint: str
    files_per_batch: int = 1000
    min_words: int = 4


def _decided(batch: DataFrame, kept_before: DataFrame) -> DataFrame:
    """A row for each document of a batch, with its decision."""
    rows = batch.select("doc_id", "source", first_filled(F.col("lang"), F.lit("en")).alias("language"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    # One row of each id and text, combined before the shuffle; texts move once.
    rows = rows.groupBy("doc_id", "digest").agg(F.min(F.struct("source", "language", "text")).alias("r")).select("doc_id", "digest", "r.*")
    rows = rows.withColumn("reason", F.when(F.col("doc_id").isNull(), "no_id").otherwise(page_drop(F.col("text"))))
    first = rows.filter("reason IS NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    fresh = first.join(kept_before, "digest", "left_anti").withColumn("fresh", F.lit(True))
    decision = F.coalesce("reason", F.when(F.col("fresh"), "kept").otherwise("repeated"))
    out = rows.join(fresh, ["doc_id", "digest"], "left").withColumn("decision", decision)
    return out.select("doc_id", "source", "language", "digest", F.length("text").alias("n_chars"), F.when(F.col("decision") == "kept", F.col("text")).alias("text"), "decision")


def insights_of(kept: DataFrame, min_words: int) -> DataFrame:
    """The sentences of at least ``min_words`` words of each document, numbered in order and tagged."""
    long = F.filter(sentences(F.col("text")), lambda s: F.size(F.split(s, r"\s+")) >= min_words)
    rows = kept.select("doc_id", "source", "language", F.posexplode(long).alias("n", "text")).withColumn("tag", rule_tag(F.col("text")))
    named = first_filled(F.col("source"), F.lit("unknown")).alias("source_name")
    return rows.select("doc_id", "n", "text", F.col("tag.insight_sentiment").alias("sentiment"), F.col("tag.intent_tag").alias("intent"), F.col("tag.numeric_anchors").alias("numbers"), "source", "language", named)


def _take(settings: Settings):
    out = settings.output

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = f"{out}/decisions/batch={number}"
        before = decisions(spark, out).filter((F.col("batch") < number) & (F.col("decision") == "kept")).select("digest")
        _decided(batch, before).write.mode("overwrite").partitionBy("decision").parquet(own)
        made = decisions(spark, out).filter(F.col("batch") == number)
        kept = made.filter("decision = 'kept'")
        insights_of(kept, settings.min_words).write.mode("overwrite").partitionBy("source_name").parquet(f"{out}/insights/batch={number}")
        counts = made.groupBy("source", "decision").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_chars").alias("n_chars"))
        counts.write.mode("overwrite").parquet(f"{out}/counts/batch={number}")
        total = spark.read.schema(COUNTS).parquet(f"{out}/counts").filter(F.col("batch") == number)
        n, kept_n = total.agg(F.sum("n_documents"), F.sum(F.when(F.col("decision") == "kept", F.col("n_documents")))).head()
        log.info("batch %d: read %s documents from %s, kept %s, wrote %s", number, n or 0, settings.input, kept_n or 0, own)

    return take


def decisions(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(DECISIONS).parquet(f"{output}/decisions")


def insights(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(INSIGHTS).parquet(f"{output}/insights")


def run(spark: SparkSession, settings: Settings) -> None:
    """Takes all new files, then sums the report anew."""
    for name, schema in (("decisions", DECISIONS), ("insights", INSIGHTS), ("counts", COUNTS)):
        spark.createDataFrame([], schema).write.mode("append").partitionBy("batch").parquet(f"{settings.output}/{name}")  # the folder, to be read from
    new = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", str(settings.files_per_batch)).parquet(settings.input)
    stream = new.writeStream.foreachBatch(_take(settings)).option("checkpointLocation", settings.checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    report = spark.read.schema(COUNTS).parquet(f"{settings.output}/counts").groupBy("source", "decision").agg(F.sum("n_documents").alias("n_documents"), F.sum("n_chars").alias("n_chars"))
    report.write.mode("overwrite").parquet(f"{settings.output}/report")
    log.info("wrote the report of all batches to %s/report", settings.output)


def ledger(spark: SparkSession, output: str) -> DataFrame:
    """The whole output by document: its decision, and what its insights are."""
    own = insights(spark, output).groupBy("batch", "doc_id").agg(
        F.count(F.lit(1)).alias("n_insights"),
        *[F.count_if(F.col(c) == v).alias(f"n_{v}") for c, v in (("sentiment", "positive"), ("sentiment", "negative"), ("sentiment", "mixed"), ("intent", "warning"), ("intent", "recommendation"))],
        F.sum(F.size("numbers")).alias("n_numbers"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n"), 256).alias("insights_sha256"),
    )
    names = [c for c in own.columns if c not in ("batch", "doc_id")]
    out = decisions(spark, output).join(own, ["batch", "doc_id"], "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) if c.startswith("n_") else F.col(c) for c in names]
    return out.select("doc_id", "source", "language", "decision", "n_chars", *zero)


if __name__ == "__main__":
    main(Settings, run, "Takes new texts into cleaned, tagged insights.")
