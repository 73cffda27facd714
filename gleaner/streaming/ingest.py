"""Incremental ingest on Structured Streaming: idempotent upserts, keyed progress state and dedupe across runs.

A feed's token is the stream's offset, kept in its checkpoint and moved only after a batch is written: at least once,
and upserts on natural keys make repeats harmless.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleaner.operators.dedupe import last_wins


def read_feed(spark: SparkSession, pages: str, size: int = 10) -> DataFrame:
    """A stream over a recorded paged feed, resuming from its token."""
    from gleaner.sources.readers import register

    register(spark)
    return spark.readStream.format("paged_feed").option("pages", pages).option("pageSize", str(size)).load()


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, key: str, sequence: str):
    """Every batch is appended with its number; ``current`` reads the latest row of each key.

    A batch that runs again overwrites its own folder, so the table is exact after failures."""

    def put(batch: DataFrame, number: int) -> None:
        last_wins(batch, [key], [sequence]).withColumn("batch_seq", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch_seq_{number:012d}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def current(spark: SparkSession, path: str, key: str, sequence: str) -> DataFrame:
    return last_wins(spark.read.parquet(f"{path}/batch_seq_*"), [key], ["batch_seq", sequence]).drop("batch_seq")


def distinct_stream(stream: DataFrame, key: str, time: str, delay: str = "7 days") -> DataFrame:
    """The first of each key within the watermark.  Times without a zone are cast first."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


@dataclass
class Progress:
    """A place's progress through its review pages.

    An empty page moves on and counts as an error; a failed fetch counts and stays; three errors in a row, the caps or the
    feed's end finish the place."""

    next_offset: int = 0
    error_streak: int = 0
    pages: int = 0
    reviews: int = 0
    exhausted: bool = False

    def see(self, kind: str, n: int, page: int = 10, streak: int = 3, most_pages: int = 1 << 30, most_reviews: int = 1 << 30) -> Progress:
        if self.exhausted:
            return self
        if kind == "end":
            self.exhausted = True
            return self
        if kind == "error":
            self.error_streak += 1
        else:
            self.pages += 1
            self.next_offset += page
            self.reviews += n
            self.error_streak = 0 if n else self.error_streak + 1
        self.exhausted = self.error_streak >= streak or self.pages >= most_pages or self.reviews >= most_reviews
        return self


PROGRESS = "poi_id string, next_offset int, error_streak int, pages int, reviews int, exhausted boolean"
_STATE = "next_offset int, error_streak int, pages int, reviews int, exhausted boolean"


def track_progress(events: DataFrame, streak: int = 3, most_pages: int = 1 << 30, most_reviews: int = 1 << 30) -> DataFrame:
    """Fetch events (poi_id, seq, kind: page, error or end, n_reviews) as each place's progress, kept as state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = Progress(*state.get) if state.exists else Progress()
        for pdf in batches:
            for kind, n in pdf.sort_values("seq")[["kind", "n_reviews"]].itertuples(index=False):
                own.see(kind, int(n), 10, streak, most_pages, most_reviews)
        values = (own.next_offset, own.error_streak, own.pages, own.reviews, own.exhausted)
        state.update(values)
        yield pd.DataFrame([(key[0], *values)], columns=[c.split()[0] for c in PROGRESS.split(", ")])

    return events.groupBy("poi_id").applyInPandasWithState(run, PROGRESS, _STATE, "update", GroupStateTimeout.NoTimeout)


def fold_progress(events: DataFrame, streak: int = 3) -> DataFrame:
    """The same progress over a finished table of events, by one fold for each place."""
    zero = F.lit(0)
    first = F.struct(zero.alias("next_offset"), zero.alias("error_streak"), zero.alias("pages"), zero.alias("reviews"), F.lit(False).alias("exhausted"))

    def step(acc, e):
        page = e["kind"] == "page"
        failed = ~page | (e["n_reviews"] == 0)
        run = F.when(failed, acc["error_streak"] + 1).otherwise(0)
        ended = e["kind"] == "end"
        moved = F.struct(
            F.when(page, acc["next_offset"] + 10).otherwise(acc["next_offset"]).alias("next_offset"),
            F.when(ended, acc["error_streak"]).otherwise(run).alias("error_streak"),
            F.when(page, acc["pages"] + 1).otherwise(acc["pages"]).alias("pages"),
            F.when(page, acc["reviews"] + e["n_reviews"]).otherwise(acc["reviews"]).alias("reviews"),
            (ended | (run >= streak)).alias("exhausted"),
        )
        return F.when(acc["exhausted"], acc).otherwise(moved)

    rows = events.groupBy("poi_id").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", F.col("n_reviews").cast("int").alias("n_reviews")))).alias("e"))
    return rows.select("poi_id", F.aggregate("e", first, step).alias("p")).select("poi_id", "p.*")


def fair_order(pending: DataFrame) -> DataFrame:
    """Round robin: the places with the fewest pages come first, ties by id."""
    return pending.filter("NOT exhausted").orderBy("pages", "poi_id")


def token_step(cursor: dict, page: dict | None) -> dict:
    """A token cursor after a page: exhausted at once stays so; no page (a failed call) keeps the token; a page without
    reviews or next token ends the feed."""
    if cursor["exhausted"] or page is None:
        return cursor
    token = page.get("next_page_token") if page.get("reviews") else None
    return {"next_page_token": token, "exhausted": token is None}
