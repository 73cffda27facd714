"""Progress of many places as keyed state with timers: what each place has been read to, which fetches to repeat, and when.

``track`` folds fetch events (poi_id, seq, kind, n_reviews) into one value of state for each place, keeps failed fetches in a
list beside it, and sets a timer for their repetition that backs off with the streak of errors.  State lives in RocksDB and
in the stream's checkpoint: a restarted stream goes on where it was, and ``progress_table`` and ``failed_fetches`` read it
from there, so that no second table has to be kept in step.

Rules of a place are those of ``ingest.Progress``.  Edge cases: a null ``poi_id`` is a place of its own; events of unknown
kind and null counts are errors and none; no events, no rows.  Within a micro-batch a place's events are put in the order of
``seq`` (nulls first, ties as they came), for which a task holds three numbers an event; batches have to come in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gleaner.streaming.ingest import Progress

EVENTS = "poi_id string, seq long, kind string, n_reviews int"
OUTPUT = "poi_id string, what string, next_offset int, error_streak int, pages int, reviews int, exhausted boolean"
_VALUE = "next_offset int, error_streak int, pages int, reviews int, exhausted boolean"
_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Tracker(StatefulProcessor):
    def __init__(self, rules: dict, wait_ms: int, most_wait_ms: int, ttl_ms: int | None):
        self.rules, self.wait_ms, self.most_wait_ms, self.ttl_ms = rules, wait_ms, most_wait_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", _VALUE, self.ttl_ms)
        self.failed = handle.getListState("failed", "seq long, next_offset int", self.ttl_ms)

    def _row(self, key: tuple, what: str, p: Progress) -> pd.DataFrame:
        return pd.DataFrame([(key[0], what, p.next_offset, p.error_streak, p.pages, p.reviews, p.exhausted)], columns=_COLUMNS)

    def _own(self) -> Progress:
        return Progress(*self.progress.get()) if self.progress.exists() else Progress()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [(f["seq"].to_numpy(np.int64), f["kind"].map({"page": 0, "end": 2}).fillna(1).to_numpy(np.int8), f["n_reviews"].fillna(0).to_numpy(np.int32)) for f in rows]
        seq, kind, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        own, failed = self._own(), []
        for k in np.argsort(seq, kind="stable"):
            if own.exhausted:
                break
            name = ("page", "error", "end")[kind[k]]
            own.see(name, int(n[k]), **self.rules)
            # Only what failed since the last page that was fetched is still to be repeated.
            failed = failed + [(int(seq[k]), own.next_offset)] if name == "error" else None
            if failed is None:
                self.failed.clear()
                failed = []
        self.progress.update((own.next_offset, own.error_streak, own.pages, own.reviews, own.exhausted))
        if own.exhausted:
            self.failed.clear()
        elif failed:
            self.failed.appendList(failed)
        self._set_timer(own, timerValues)
        yield self._row(key, "progress", own)

    def _set_timer(self, own: Progress, times) -> None:
        """One timer for each place that has a fetch to repeat, none for others."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        if self.failed.exists() and not own.exhausted:
            wait = min(self.wait_ms * 2 ** min(own.error_streak - 1, 30), self.most_wait_ms)
            self.handle.registerTimer(times.getCurrentProcessingTimeInMs() + wait)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A repetition falls due: said once, then forgotten until the fetch fails again."""
        if self.failed.exists():
            self.failed.clear()
            yield self._row(key, "retry", self._own())

    def close(self) -> None:
        pass


def track(events: DataFrame, streak: int = 3, most_pages: int = 1 << 30, most_reviews: int = 1 << 30, wait_ms: int = 4_000, most_wait_ms: int = 3_600_000, ttl_ms: int | None = None) -> DataFrame:
    """Rows (what: progress) for each place that a micro-batch brings events of, and (what: retry) where a failed fetch is due again.

    ``wait_ms`` doubles with each error of a streak up to ``most_wait_ms``.  With ``ttl_ms`` a place that brought nothing for
    so long is forgotten and begins anew."""
    if events.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    rules = {"streak": streak, "most_pages": most_pages, "most_reviews": most_reviews}
    rows = events.select("poi_id", F.coalesce(F.col("seq").cast("long"), F.lit(-1 << 63)).alias("seq"), "kind", F.coalesce(F.col("n_reviews").cast("int"), F.lit(0)).alias("n_reviews"))
    return rows.groupBy("poi_id").transformWithStateInPandas(_Tracker(rules, wait_ms, most_wait_ms, ttl_ms), OUTPUT, "Update", "ProcessingTime")


def catch_up(spark: SparkSession, writer: DataStreamWriter) -> None:
    """Runs a tracking stream over all that is there, then ends.

    Timers ask for batches without data for ever, with which ``availableNow`` alone never ends; those that are due by then
    fire with the next data or in a stream that is kept running."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


def progress_table(spark: SparkSession, checkpoint: str) -> DataFrame:
    """poi_id and progress of every place, from the last batch that the checkpoint holds."""
    return _state(spark, checkpoint, "progress").select(F.col("key.poi_id").alias("poi_id"), "value.*")


def failed_fetches(spark: SparkSession, checkpoint: str) -> DataFrame:
    """poi_id, seq and next_offset of fetches that wait to be repeated."""
    rows = _state(spark, checkpoint, "failed")
    return rows.select(F.col("key.poi_id").alias("poi_id"), F.col("list_element.seq").alias("seq"), F.col("list_element.next_offset").alias("next_offset"))
