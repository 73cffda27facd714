"""Sources: schemas of the store, file-backed readers with fallbacks, a registry, and paged feeds as a data source.

The paged feed replays recorded pages.  It is the offline counterpart of the review interfaces: batch reads page
through everything, streams resume from a saved token.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader

from gleaner.models import throttle

RAW = "source string, source_id string, source_uuid string, poi_id string, poi_name string, city string, rating int, text string, meta map<string,string>, source_url string"
FLAT = "flat_idx bigint, source string, source_id string, poi_id string, poi_name string, rating int, text string, strength double, anchor_entity string"
CURSOR = "poi_id string, sort_mode string, next_page_token string, next_offset int, exhausted boolean"
LINKS = "item_id string, item_type string, poi_id string, match_source string, intent_category string, query_term string, discovered_via string, query_sort string"
LINK_KEY = ["item_id", "item_type", "poi_id", "match_source", "intent_category", "query_term"]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any file system that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file of one JSON array; no rows if it is missing."""
    return spark.read.schema(schema).json(path, multiLine=True) if exists(spark, path) else spark.createDataFrame([], schema)


def first_of(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The first path that is there; an error if none is."""
    for p in paths:
        if exists(spark, p):
            return json_rows(spark, p, schema)
    raise FileNotFoundError(f"none of {paths}")


def last_built(spark: SparkSession, path: str) -> str:
    """When a file was last written, to the second, in the driver's time zone."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p)
    return datetime.fromtimestamp(status.getModificationTime() / 1000).isoformat(timespec="seconds")


def recorded_feed(spark: SparkSession, path: str, size: int = 10) -> DataFrame:
    """poi_id, token, offset and item (JSON) of feeds of any number of places, recorded as JSON lines (poi_id, token, items).

    A place's feed ends before its first page without items.  Files are split as Spark reads them; only the places that
    have an empty page, and its number, are shuffled."""
    pages = spark.read.schema("poi_id string, token int, items array<string>").json(path)
    ends = pages.filter("items IS NULL OR size(items) = 0").groupBy("poi_id").agg(F.min("token").alias("end"))
    own = pages.join(ends, "poi_id", "left").filter("end IS NULL OR token < end")
    return own.select("poi_id", "token", F.posexplode("items").alias("k", "item")).select("poi_id", "token", (F.col("token") * size + F.col("k")).alias("offset"), "item")


def place_rows(df: DataFrame, poi: str, n: int, order: str) -> DataFrame:
    return df.filter(F.col("poi_name") == poi).orderBy(order).limit(n)


class Registry:
    """Row sources by name."""

    def __init__(self):
        self._makers: dict[str, Callable[[SparkSession], DataFrame]] = {}

    def add(self, name: str, maker: Callable[[SparkSession], DataFrame]) -> None:
        self._makers[name] = maker

    def read(self, spark: SparkSession, names: list[str] | None = None) -> DataFrame:
        """All rows of the named sources, their name as default ``source``; unknown names raise."""
        chosen = names or list(self._makers)
        if missing := [n for n in chosen if n not in self._makers]:
            raise KeyError(f"no such sources: {missing}")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [tagged(self._makers[n](spark), n) for n in chosen])


def tagged(df: DataFrame, source: str) -> DataFrame:
    own = F.coalesce("source", F.lit(source)) if "source" in df.columns else F.lit(source)
    return df.withColumn("source", own)


def matrix_rows(meta: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Vectors beside their metadata, joined on an id rather than by place in a file."""
    from gleaner.operators.vectors import normalize

    return meta.join(vectors.select(key, normalize(F.col("embedding")).alias("embedding")), key)


class _Pages:
    def __init__(self, options: dict):
        self.pages = json.loads(options["pages"])
        self.most, self.size = int(options.get("maxcalls", "1000000")), int(options.get("pagesize", "10"))
        self.interval = float(options.get("interval", "0"))

    def page(self, token: int) -> list:
        throttle("paged_feed", self.interval)
        return self.pages[token] if token < len(self.pages) else []


class _PageReader(_Pages, DataSourceReader):
    def read(self, partition) -> Iterator[tuple]:
        for token in range(min(self.most, len(self.pages))):
            rows = self.page(token)
            if not rows:
                return
            for k, r in enumerate(rows):
                yield token, token * self.size + k, json.dumps(r, ensure_ascii=False)


class _PageStream(_Pages, SimpleDataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"token": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self.page(start["token"])
        step = {"token": start["token"] + 1} if rows else start
        return iter([(start["token"], start["token"] * self.size + k, json.dumps(r, ensure_ascii=False)) for k, r in enumerate(rows)]), step

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for token in range(start["token"], end["token"]):
            yield from self.read({"token": token})[0]


class PagedFeed(DataSource):
    """Format ``paged_feed``: option ``pages`` is a JSON array of pages (arrays of items); a page without items ends the
    feed.  ``maxCalls`` bounds a batch read, ``pageSize`` the offsets, ``interval`` the seconds between calls.  Rows: token, offset, item (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return "token int, offset int, item string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader({k.lower(): v for k, v in self.options.items()})

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _PageStream({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedFeed)


def write_rows(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)
