"""Feeds of many places as a partitioned source: recorded calls in a folder, read in many tasks, resumed at each place's own call.

``record`` writes calls (poi_id, call, token, next_token, items, failed) with Spark, in a folder for each slot of
places and block of calls, so that neither many places nor one long feed fall to one task, and appends how many calls each
place has.  Format ``place_pages`` reads the folder:

* a batch read takes each place's calls from the first on, up to ``maxCalls`` of them; ``places`` (a JSON array), ``fromCall``
  and ``toCall`` (excluded) choose, so that only slots and blocks that hold such calls are opened.  These are options and no
  pushed filters, as Spark keeps what was pushed for one query of a loaded Python source for the DataFrame's other queries;
* a stream's offset is the number of calls taken of each place; a batch opens only the blocks that hold newer ones.

A failed call gives no rows and its token is asked for again by the next call that was recorded; ``cursors`` tells where each
place stands.  A place's feed ends with its first call that didn't fail and has no items or no next token; later calls of it
are never read.

Rows: poi_id, call, token, offset (``pageSize`` times the calls before that didn't fail, and the place on the page), item.

Edge cases: a null ``poi_id`` or ``call`` can't be resumed and is refused by ``record``; null items are none; of a call that
is recorded twice at once one counts, the one that didn't fail first; an empty table leaves a folder without places; extra columns are ignored.

The driver holds a number for each place (as the offset does in the checkpoint), never pages.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.window import Window

from gleaner.sources.readers import exists

CALLS = "poi_id string, call int, token string, next_token string, items array<string>, failed boolean"
ROWS = "poi_id string, call int, token string, offset int, item string"
SLOTS, BLOCK = 32, 1_000
_BATCH = 4_096


def _slot(slots: int):
    """The slot of a place; Python learns it from the list of places."""
    return F.pmod(F.xxhash64("poi_id"), F.lit(slots)).cast("int")


def record(calls: DataFrame, folder: str, slots: int = SLOTS, block: int = BLOCK) -> None:
    """Appends calls to the folder; those of a place come after those that are there.  ``slots`` and ``block`` stay as first given."""
    spark = calls.sparkSession
    named = calls.select("poi_id", F.col("call").cast("int").alias("call"), "token", "next_token", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("failed", F.lit(False)).alias("failed"))
    whole = named.select(F.when(F.col("poi_id").isNull() | F.col("call").isNull(), F.raise_error(F.lit("a call without place or number"))).otherwise(F.col("poi_id")).alias("poi_id"), *named.columns[1:])
    one = whole.groupBy("poi_id", "call").agg(F.min_by(F.struct("token", "next_token", "items", "failed"), F.struct("failed", "token", "items")).alias("c")).select("poi_id", "call", "c.*")
    slot, part = _slot(slots), F.floor(F.col("call") / block).cast("int")
    # How many calls went well before: sums of blocks first, so that no window holds a long feed.
    blocks = one.groupBy("poi_id", part.alias("block")).agg(F.count_if(~F.col("failed")).alias("well"))
    before = F.coalesce(F.sum("well").over(Window.partitionBy("poi_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = blocks.select("poi_id", "block", before.alias("earlier"))
    known = _places(spark, folder)
    if known is not None:
        start = start.join(known.select("poi_id", "well"), "poi_id", "left").select("poi_id", "block", (F.col("earlier") + F.coalesce("well", F.lit(0))).alias("earlier"))
    own = Window.partitionBy("poi_id", "block").orderBy("call").rowsBetween(Window.unboundedPreceding, -1)
    rows = one.withColumn("block", part).join(start, ["poi_id", "block"])
    rows = rows.withColumn("page", (F.col("earlier") + F.coalesce(F.count_if(~F.col("failed")).over(own), F.lit(0))).cast("int")).drop("earlier")
    laid = rows.withColumn("slot", slot).repartition("slot", "block").sortWithinPartitions("slot", "block", "poi_id", "call")
    laid.write.mode("append").partitionBy("slot", "block").json(f"{folder}/pages")
    ended = ~F.col("failed") & ((F.size("items") == 0) | F.col("next_token").isNull())
    ends = F.min(F.when(ended, F.col("call")))
    places = one.groupBy("poi_id").agg((F.max("call") + 1).alias("calls"), ends.alias("ended"), F.count_if(~F.col("failed")).alias("well"), F.max_by(F.col("token"), "call").alias("asked"), F.max_by(F.when(~F.col("failed"), F.col("next_token")), "call").alias("given"), F.max_by("failed", "call").alias("failed"))
    places.withColumn("slot", slot).withColumn("block", F.lit(block)).write.mode("append").json(f"{folder}/places")


_PLACE = "poi_id string, calls int, ended int, well long, asked string, given string, failed boolean, slot int, block int"


def _places(spark: SparkSession, folder: str) -> DataFrame | None:
    """A row for each place over all that was recorded."""
    if not exists(spark, f"{folder}/places"):
        return None
    own = F.col("calls")
    last = {c: F.max_by(c, own).alias(c) for c in ("asked", "given", "failed")}
    return spark.read.schema(_PLACE).json(f"{folder}/places").groupBy("poi_id").agg(F.max(own).alias("calls"), F.min("ended").alias("ended"), F.sum("well").alias("well"), *last.values())


def cursors(spark: SparkSession, folder: str) -> DataFrame:
    """poi_id, calls, next_page_token and exhausted of each place: a failed call keeps the token it asked for, an ended feed has none."""
    p = _places(spark, folder)
    if p is None:
        return spark.createDataFrame([], "poi_id string, calls int, next_page_token string, exhausted boolean")
    over = F.col("ended").isNotNull()
    token = F.when(~over, F.when(F.col("failed"), F.col("asked")).otherwise(F.col("given")))
    return p.select("poi_id", F.when(over, F.col("ended") + 1).otherwise(F.col("calls")).alias("calls"), token.alias("next_page_token"), over.alias("exhausted"))


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """A folder of any file system that Arrow knows; what it doesn't raises."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _lines(folder: str) -> Iterator[dict]:
    """The records of a folder's files, one line at a time."""
    system, path = _open(folder)
    for f in sorted(system.get_file_info(fs.FileSelector(path, allow_not_found=True)), key=lambda f: f.path):
        if f.is_file and f.base_name.endswith(".json"):
            with system.open_input_stream(f.path) as raw:
                rest = b""
                while data := raw.read(1 << 20):
                    *whole, rest = (rest + data).split(b"\n")
                    yield from (json.loads(x) for x in whole if x)
                if rest:
                    yield json.loads(rest)


class _Part(InputPartition):
    """A block of a slot, with the calls to take of each of its places: from, to."""

    def __init__(self, slot: int, block: int, ranges: dict[str, tuple[int, int]]):
        self.slot, self.block, self.ranges = slot, block, ranges


class _Folder:
    def __init__(self, options: dict):
        self.folder, self.size = options["path"].rstrip("/"), int(options.get("pagesize", "10"))
        self.most = int(options.get("maxcalls", str(1 << 30)))

    def known(self) -> tuple[dict[str, int], dict[str, int], int]:
        """How many calls of each place can be read, its slot, and the length of blocks."""
        calls, ends, slots, block = {}, {}, {}, BLOCK
        for p in _lines(f"{self.folder}/places"):
            name = p["poi_id"]
            calls[name], slots[name], block = max(calls.get(name, 0), p["calls"]), p["slot"], p["block"]
            if "ended" in p:
                ends[name] = min(ends.get(name, 1 << 31), p["ended"] + 1)
        return {k: min(n, ends.get(k, n)) for k, n in calls.items()}, slots, block

    def parts(self, ranges: dict[str, tuple[int, int]], slots: dict[str, int], block: int) -> list[_Part]:
        laid: dict[tuple[int, int], dict] = defaultdict(dict)
        for name, (low, high) in ranges.items():
            for b in range(low // block, -(-high // block)) if low < high else ():
                laid[slots[name], b][name] = (low, high)
        return [_Part(s, b, own) for (s, b), own in sorted(laid.items())]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        columns: list[list] = [[] for _ in range(5)]

        def full() -> pa.RecordBatch:
            types = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string())
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["poi_id", "call", "token", "offset", "item"])
            for c in columns:
                c.clear()
            return out

        # A call of an earlier recording counts before one of the same number.
        seen: set[tuple[str, int]] = set()
        for c in _lines(f"{self.folder}/pages/slot={part.slot}/block={part.block}"):
            low, high = part.ranges.get(c["poi_id"], (0, 0))
            at = (c["poi_id"], c["call"])
            if c["failed"] or not low <= c["call"] < high or at in seen:
                continue
            seen.add(at)
            for k, item in enumerate(c["items"]):
                for column, x in zip(columns, (c["poi_id"], c["call"], c.get("token"), c["page"] * self.size + k, item), strict=True):
                    column.append(x)
                if len(columns[0]) >= _BATCH:
                    yield full()
        if columns[0]:
            yield full()


class _Reader(_Folder, DataSourceReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.names = set(json.loads(options["places"])) if "places" in options else None
        self.low, self.high = int(options.get("fromcall", "0")), min(self.most, int(options.get("tocall", str(1 << 30))))

    def partitions(self) -> list[_Part]:
        calls, slots, block = self.known()
        chosen = {k: (self.low, min(n, self.high)) for k, n in calls.items() if self.names is None or k in self.names}
        # No partition at all would be read as one of unknown extent.
        return self.parts(chosen, slots, block) or [_Part(0, 0, {})]


class _Stream(_Folder, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.known()[0]

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        _, slots, block = self.known()
        return self.parts({k: (start.get(k, 0), n) for k, n in end.items()}, slots, block) or [_Part(0, 0, {})]


class PlacePages(DataSource):
    """Format ``place_pages``: a folder that ``record`` wrote; options ``pageSize`` and, in batch reads, ``maxCalls``, ``places``, ``fromCall``, ``toCall``."""

    @classmethod
    def name(cls) -> str:
        return "place_pages"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream({k.lower(): v for k, v in self.options.items()})


def read(spark: SparkSession, folder: str, places: list[str] | None = None, **options: int) -> DataFrame:
    spark.dataSource.register(PlacePages)
    own = {"places": json.dumps(places)} if places is not None else {}
    return spark.read.format("place_pages").options(**own, **options).load(folder)


def stream(spark: SparkSession, folder: str, **options: int) -> DataFrame:
    spark.dataSource.register(PlacePages)
    return spark.readStream.format("place_pages").options(**options).load(folder)
