"""N-gram Jaccard join: exact similarity groups by rare-first prefix filtering.

1.  ``_signatures``: a document's set of word shingles (64-bit hashes), a 128-bit digest of the set, and the set's share
    of a count sketch.  Documents of equal sets form a class, told apart by the whole digest and numbered; only one row of each
    class goes on, copies and repeated rows are membership.
2.  ``_prefixes``: shingles in the global order rare first (sketched count, then hash; any one order for all documents
    is right, a rare-first one is cheap).  Two sets that reach the threshold share a shingle among the first
    ``n - ceil(t n) + 1`` of both, so only those are joined on.
3.  Candidates that share a prefix shingle pass the length filter, the positional filter (what is left after the shared
    shingle bounds the overlap) and the suffix filter (the sets' counts per hash cell differ by at least the size of
    their difference), then each pair is verified once on whole sets.
4.  ``groups`` needs no links but those that join components.  Rounds keep large groups of near copies from making all pairs:
    in the first ones each member of a prefix bucket is paired with its neighbours in a random order (``ORDERS`` different
    ones, by bucket), hot buckets in salted parts, and components are found; later rounds go on with buckets whose members
    are in different components, and new links only join the components found.  The last round pairs all such members.
5.  ``join`` gives every link: all pairs of classes that reach the threshold, with each document's class.
    A hot bucket's pairs are made by bands of length, as sets of bands further apart can't be linked, and by parts of a band.

Edge cases: null and empty texts have the empty set and link with nothing; so do rows with a null doc_id (their
component is null); texts shorter than a shingle have one shingle, the whole; rows of one doc_id and other texts are
rows of their own; clashing extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm.common import forget, quoted, shingles, small, unused, words_of, written
from gleaner.llm.components import components

#: Counters of the sketch that orders shingles, and the pieces in which it is summed.
SKETCH, SLICES, CELLS = 1 << 20, 64, 32
#: Up to this many candidates' ids go to all executors to pick their texts; more are joined by shuffle.
SMALL_CANDIDATES = 300_000
#: Random orders of buckets' members, and rounds of neighbours before all remaining pairs are tried.
ORDERS, ROUNDS = 16, 3
#: Neighbours that are tried in a round, the first round having most to try and needing least.
NEIGHBOURS = (1, 12, 12)
#: Members of a part of a hot bucket, about, and of the sketch's mean cell: the sketch can't tell buckets below that apart.
PART, CELL = 1000, 8
#: Buckets that are sent to every executor at most, and pieces of the sketch that a task sums.
SMALL_BUCKETS, PIECES = 300_000, 256


@dataclass(frozen=True)
class Similarity:
    """Linked when 100 * intersection >= percent * union of the sets of ``width``-word shingles."""

    width: int = 5
    percent: int = 80
    seed: int = 0

    def least_overlap(self, both: Column) -> Column:
        """The smallest intersection of two sets of summed size ``both`` that are linked."""
        return F.ceil(both * self.percent / (100 + self.percent) - 1e-9)

    def prefix(self, n: int) -> int:
        return n - -(-n * self.percent // 100) + 1

    def lengths_agree(self, x: Column, y: Column) -> Column:
        return 100 * F.least(x, y) >= self.percent * F.greatest(x, y)


_SIGNATURE = "doc_id long, n long, d1 long, d2 long, slice int, counts binary"


def _set_of(text: str | None, sim: Similarity) -> np.ndarray:
    return shingles(words_of(text), sim.width, sim.seed)


def _digest(own: np.ndarray, doc_id: int) -> tuple[int, int]:
    """The two halves of a set's digest."""
    d = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes() if len(own) else b"none %d" % doc_id), ">i8")
    return int(d[0]), int(d[1])


def _signatures(sim: Similarity):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = np.zeros(SKETCH, np.uint32)
        for pdf in batches:
            rows = []
            for d, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                own = _set_of(text, sim)
                sketch[(own & np.uint64(SKETCH - 1)).astype(np.int64)] += 1  # a set's clashes count once: an order is all that is needed
                rows.append((d, len(own), *_digest(own, d), None, None))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "d1", "d2", "slice", "counts"])
        parts = [(0, 0, 0, 0, k, zlib.compress(x.tobytes(), 1)) for k, x in enumerate(np.split(sketch, SLICES)) if x.any()]
        yield pd.DataFrame(parts, columns=["doc_id", "n", "d1", "d2", "slice", "counts"])

    return run


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for pdf in batches:
        for k, data in zip(pdf["slice"], pdf["counts"], strict=True):
            own = np.frombuffer(zlib.decompress(data), np.uint32)
            total[k] = total[k] + own if k in total else own.astype(np.uint64)
    yield pd.DataFrame({"slice": list(total), "counts": [zlib.compress(np.minimum(x, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1) for x in total.values()]})


def _sketch(signatures: DataFrame) -> np.ndarray:
    """The summed sketch: ``SKETCH`` counters whatever the input; its pieces are summed in a tree."""
    parts = signatures.filter("slice IS NOT NULL").select("slice", "counts", F.monotonically_increasing_id().alias("at"))
    groups = -(-parts.count() // (SLICES * PIECES))
    if groups > 1:
        parts = parts.repartition(SLICES * groups, "slice", F.pmod("at", F.lit(groups))).select("slice", "counts").mapInPandas(_summed, "slice int, counts binary")
    parts = parts.select("slice", "counts").repartition(SLICES, "slice").mapInPandas(_summed, "slice int, counts binary").collect()
    out = np.zeros((SLICES, SKETCH // SLICES), np.uint32)
    for r in parts:
        out[r.slice] = np.frombuffer(zlib.decompress(r.counts), np.uint32)
    return out.reshape(-1)


def _prefixes(sim: Similarity, sketch, part: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = sketch.value
        size = max(part, CELL * int(counts.mean(dtype=np.float64)))
        for pdf in batches:
            rows = []
            for d, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                own = _set_of(text, sim)
                if len(own):
                    rare = np.lexsort((own, counts[(own & np.uint64(SKETCH - 1)).astype(np.int64)]))[: sim.prefix(len(own))]
                    # Cut at 127: cut counts differ by no more than whole ones.
                    cells = np.minimum(np.bincount((own >> np.uint64(59)).astype(np.int64), minlength=CELLS), 127)
                    parts = -(-counts[(own[rare] & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.int64) // size)
                    rows.append((d, len(own), *_digest(own, d), own[rare].view(np.int64), np.maximum(parts, 1).astype(np.int32), cells.astype(np.int8)))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "d1", "d2", "prefix", "parts", "cells"])

    return run


def _packed(sim: Similarity):
    """The words of each candidate, compressed: they take less than half of the set's hashes, which are made again from them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for node, d1, d2, text in zip(pdf["node"], pdf["d1"], pdf["d2"], pdf["text"], strict=True):
                own = words_of(text)
                # Where rows share a doc_id, only one whose set is the class's counts.
                if _digest(shingles(own, sim.width, sim.seed), 0) == (d1, d2):
                    rows.append((node, zlib.compress(b" ".join(own), 1)))
            yield pd.DataFrame(rows, columns=["node", "own"])

    return run


class _Sets:
    """Sets made from packed words, those used last kept up to a number of shingles: pairs come in groups that share them."""

    def __init__(self, sim: Similarity, most: int = 2_000_000):
        self.sim, self.most, self.held, self.kept = sim, most, 0, {}

    def of(self, node: int, data: bytes) -> np.ndarray:
        own = self.kept.pop(node, None)
        if own is None:
            own = shingles(zlib.decompress(data).split(), self.sim.width, self.sim.seed)
            self.held += len(own)
            while self.held > self.most and self.kept:
                self.held -= len(self.kept.pop(next(iter(self.kept))))
        self.kept[node] = own
        return own


def _verify(sim: Similarity):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = _Sets(sim)
        for pdf in batches:
            keep = np.zeros(len(pdf), bool)
            for k, (u, v, x, y) in enumerate(zip(pdf["u"], pdf["v"], pdf["own_u"], pdf["own_v"], strict=True)):
                own, other = sets.of(v, y), sets.of(u, x)
                both = len(own) + len(other)
                shared = both - len(np.unique(np.concatenate([other, own])))
                keep[k] = 100 * shared >= sim.percent * (both - shared)
            yield pdf.loc[keep, ["u", "v"]]

    return run


class _Join:
    """The steps after the classes are known; ``reps`` has node, d1, d2, n, doc_id and cells of each class."""

    def __init__(self, docs: DataFrame, reps: DataFrame, sim: Similarity):
        self.docs, self.reps, self.sim = docs, reps, sim

    def possible(self, x: Column, y: Column) -> Column:
        """Length and positional filter over structs of n and pos (counted from 0)."""
        left = F.least(x["n"] - x["pos"], y["n"] - y["pos"])
        return self.sim.lengths_agree(x["n"], y["n"]) & (left >= self.sim.least_overlap(x["n"] + y["n"]))

    def near(self, n_x: Column, n_y: Column, x: Column, y: Column) -> Column:
        """The suffix filter: sets of these sizes and cells may be near enough."""
        apart = F.aggregate(F.zip_with(x, y, lambda a, b: F.abs(a.cast("int") - b.cast("int"))), F.lit(0), lambda a, d: a + d)
        return apart <= n_x + n_y - 2 * self.sim.least_overlap(n_x + n_y)

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) that reach the threshold: suffix filter, then whole sets."""
        sides = [self.reps.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("cells").alias(f"cells_{s}")) for s in "uv"]
        near = self.near(F.col("n_u"), F.col("n_v"), F.col("cells_u"), F.col("cells_v"))
        close = written(pairs.join(sides[0], "u").join(sides[1], "v").filter(near).select("u", "v"), "close-pairs")
        wanted = close.select(F.col("u").alias("node")).unionByName(close.select(F.col("v").alias("node"))).distinct()
        picked = written(wanted.join(self.reps, "node").select("node", "d1", "d2", "doc_id"), "picked")
        texts = self.docs.join(small(picked, SMALL_CANDIDATES), "doc_id").select("node", "d1", "d2", "text")
        # Repeated rows are alike: one of each class stays, so that a pair is verified once.
        own = written(texts.mapInPandas(_packed(self.sim), "node long, own binary").dropDuplicates(["node"]), "packed-words")
        sets = [own.select(F.col("node").alias(s), F.col("own").alias(f"own_{s}")) for s in "uv"]
        pairs = close.join(sets[0], "u").join(sets[1], "v").sortWithinPartitions("v", "u")
        links = written(pairs.mapInPandas(_verify(self.sim), "u long, v long").distinct(), "links")
        forget(close, picked, own)
        return links

    def neighbours(self, buckets: DataFrame, round_: int) -> DataFrame:
        """The rows of buckets with the members ``before`` each in the round's order, nearest first, and one after it.

        Buckets that the sketch takes for larger than a part are cut into ``parts``, by another hash in each round."""
        part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node", F.lit(round_), F.lit("part")), "parts")).otherwise(0).cast("int")
        # What the order is made of is computed behind the shuffle, which so carries ids and places alone.
        rows = buckets.withColumn("part", part).repartition("g", "part")
        rows = rows if "c" in rows.columns else rows.withColumn("c", F.col("node"))
        order = Window.partitionBy("g", "part").orderBy(F.xxhash64("node", F.pmod("g", F.lit(ORDERS)), F.lit(round_)), "node")
        member = F.struct("node", "n", "pos", "c")
        before = F.array_compact(F.array(*[F.lag(member, k).over(order) for k in range(1, NEIGHBOURS[round_] + 1)]))
        return rows.withColumns({"before": before, "after": F.lead("node").over(order)})

    def neighbour_pairs(self, rows: DataFrame) -> DataFrame:
        """Neighbours of different components that pass the filters."""
        fits = F.filter("before", lambda p: (p["c"] != F.col("c")) & (p["node"] != F.col("node")) & self.possible(p, F.struct("n", "pos")))
        pairs = rows.select("node", F.explode(F.transform(fits, lambda p: p["node"])).alias("other"))
        return pairs.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()

    def mixed(self, buckets: DataFrame, component: DataFrame, tried: int) -> DataFrame:
        """The rows, with their components ``c``, of buckets that hold more than one component.

        Members were paired with ``tried`` neighbours: in a whole bucket of at most one more, that were all pairs."""
        known = component.select("node", "component")
        rows = buckets.select("g", "node", "n", "pos", "parts").join(known, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        several = rows.groupBy("g").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("m"), F.max("parts").alias("parts"))
        several = several.filter((F.col("low") != F.col("high")) & ((F.col("m") > tried + 1) | (F.col("parts") > 1))).select("g")
        # Sent to all while they are few; the shuffle beyond is split where a bucket is large.
        return written(rows.join(small(written(several, "several"), SMALL_BUCKETS), "g", "left_semi"), "mixed-buckets")

    def all_pairs(self, members: DataFrame) -> DataFrame:
        """All pairs of a bucket, of different components ``c`` and within the filters.

        Hot buckets are tried by bands of length (sets whose sizes agree are in one band or in neighbouring ones), and a
        band's members are spread over ``parts`` that each meet all of the band and of the next."""
        rows = written(members.join(self.reps.select("node", "cells"), "node"), "members")
        ratio = math.log(100 / self.sim.percent)
        band = (F.floor(F.ln("n") / ratio + 1e-9) if ratio else F.col("n")).cast("long")
        hot = rows.filter("parts > 1").withColumn("band", band)
        x = hot.withColumns({"key": F.col("band"), "part": F.pmod(F.xxhash64("node"), "parts")})
        y = hot.withColumn("key", F.explode(F.array("band", F.col("band") - 1) if ratio else F.array("band")))
        y = y.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
        once = (F.col("x.band") < F.col("y.band")) | (F.col("x.node") < F.col("y.node"))
        found = self.met(x, y, ["g", "key", "part"], once)
        rest = rows.filter("parts = 1")
        return written(self.met(rest, rest, ["g"], F.col("x.node") < F.col("y.node")).unionByName(found).distinct(), "pairs-of-buckets")

    def met(self, x: DataFrame, y: DataFrame, keys: list[str], once: Column) -> DataFrame:
        """The pairs of rows of equal keys and different components that pass the filters."""
        x, y = x.alias("x"), y.alias("y")
        equal = reduce(Column.__and__, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys])
        fits = self.possible(F.struct("x.n", "x.pos"), F.struct("y.n", "y.pos")) & self.near(F.col("x.n"), F.col("y.n"), F.col("x.cells"), F.col("y.cells"))
        pairs = x.join(y, equal & once & (F.col("x.c") != F.col("y.c")) & fits)
        return pairs.select(F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v"))

    def joined(self, component: DataFrame, links: DataFrame) -> DataFrame:
        """The components after more links: only those found are joined, nothing is found anew."""
        sides = [component.select(F.col("node").alias(s), F.col("component").alias(f"c_{s}")) for s in "uv"]
        between = links.join(sides[0], "u", "left").join(sides[1], "v", "left").select(F.coalesce("c_u", "u").alias("u"), F.coalesce("c_v", "v").alias("v"))
        between = components(between).withColumnsRenamed({"node": "n", "component": "least"})
        moved = component.join(between, F.col("component") == F.col("n"), "left").select("node", F.coalesce("least", "component").alias("component"))
        fresh = between.join(component, F.col("n") == F.col("node"), "left_anti").select(F.col("n").alias("node"), F.col("least").alias("component"))
        return written(moved.unionByName(fresh), "components")

    def components(self, postings: DataFrame) -> DataFrame:
        """node, component over all links that matter, from postings (g, node, n, pos, parts)."""
        rows = self.neighbours(postings, 0)
        buckets = written(rows.filter("size(before) > 0 OR after IS NOT NULL OR parts > 1").drop("part", "after"), "buckets")
        tried = written(self.neighbour_pairs(buckets), "pairs")
        component = components(self.linked(tried))
        for round_ in range(1, ROUNDS + 1):
            last, buckets = buckets, self.mixed(buckets, component, NEIGHBOURS[round_ - 1])
            forget(last)
            found = self.neighbour_pairs(self.neighbours(buckets, round_)) if round_ < ROUNDS else self.all_pairs(buckets)
            fresh = written(found.join(tried, ["u", "v"], "left_anti"), "pairs")
            more = self.linked(fresh)
            if not more.isEmpty():
                component = self.joined(component, more)
            if round_ < ROUNDS:
                tried = tried.unionByName(fresh)
        forget(buckets)
        return component


class _Classes:
    """The classes of equal sets of the rows with a doc_id, and the postings of their prefixes."""

    def __init__(self, named: DataFrame, sim: Similarity):
        spark = named.sparkSession
        self.sim = sim
        signatures = written(named.mapInPandas(_signatures(sim), _SIGNATURE), "signatures")
        self.own = signatures.filter("slice IS NULL").select("doc_id", "n", "d1", "d2")
        classes = self.own.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
        # Numbers are given once, in a table that is written: no two classes share one.
        self.classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
        sketch = spark.sparkContext.broadcast(_sketch(signatures))
        shape = "doc_id long, n long, d1 long, d2 long, prefix array<long>, parts array<int>, cells array<tinyint>"
        chosen = named.mapInPandas(_prefixes(sim, sketch, PART), shape).join(self.classes.withColumnRenamed("rep", "doc_id"), ["d1", "d2", "doc_id"])
        self.chosen = written(chosen.dropDuplicates(["d1", "d2", "doc_id"]), "prefixes")
        self.postings = self.chosen.select(F.posexplode(F.arrays_zip("prefix", "parts")).alias("pos", "x"), "node", "n").select("x.prefix", "node", "n", "pos", "x.parts").withColumnRenamed("prefix", "g")
        self.join = _Join(named, self.chosen.select("node", "d1", "d2", "n", "doc_id", "cells"), sim)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def groups(docs: DataFrame, sim: Similarity = Similarity()) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row of ``docs``."""
    rows = _rows(docs)
    found = _Classes(rows.filter("doc_id IS NOT NULL"), sim)
    component = found.join.components(found.postings)
    named_by = found.classes.join(component, "node", "left").select("d1", "d2", "rep", F.coalesce("component", "node").alias("c"))
    least = named_by.groupBy("c").agg(F.min("rep").alias("component_id"))
    final = written(named_by.join(least, "c").select("d1", "d2", "component_id"), "class-components")
    forget(found.classes, found.chosen)
    out = found.own.join(final, ["d1", "d2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    unnamed = rows.filter("doc_id IS NULL").mapInPandas(_sizes(sim), "doc_id long, n_shingles long, component_id long")
    return out.unionByName(unnamed)


def join(docs: DataFrame, sim: Similarity = Similarity()) -> tuple[DataFrame, DataFrame]:
    """All links: (u, v) pairs of classes of equal sets, named by their smallest doc_id (u < v), that reach the threshold; and
    doc_id, n_shingles, class_id and n_links (of its class to others) of each row of ``docs`` with a doc_id.

    Rows of one class are linked with each other and share their class's links; a row without shingles is a class of none."""
    found = _Classes(_rows(docs).filter("doc_id IS NOT NULL"), sim)
    links = found.join.linked(written(found.join.all_pairs(found.postings.withColumn("c", F.col("node"))), "pairs"))
    names = found.classes.select("node", "rep")
    ends = links.join(names.withColumnsRenamed({"node": "u", "rep": "ru"}), "u").join(names.withColumnsRenamed({"node": "v", "rep": "rv"}), "v")
    n = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    members = found.own.join(found.classes, ["d1", "d2"], "left").join(n, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    # Classes of one smallest id (rows of one doc_id and different texts) are told apart by no name: their pairs keep both.
    return ends.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")), members


def _sizes(sim: Similarity):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = [len(_set_of(t, sim)) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pd.Series([None] * len(n), dtype="Int64"), "n_shingles": n, "component_id": pd.Series([None] * len(n), dtype="Int64")})

    return run


def keep_one(docs: DataFrame, sim: Similarity = Similarity()) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id; rows with a null doc_id or without shingles stay.

    Rows are told apart by a hash of id and text, so repeated ids are right; of equal rows one stays."""
    key = F.xxhash64("doc_id", "text")
    named = docs.filter("doc_id IS NOT NULL")
    found = groups(named.select(key.alias("doc_id"), "text"), sim).filter("n_shingles > 0")
    found = written(found.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_c")), "rows-of-components")
    row, place = unused(docs, "row"), unused(docs, "place")
    moved = found.filter("_row <> _c")
    copies = written(moved.unionByName(moved.select(F.col("_c").alias("_row"), "_c")).distinct(), "near-copies")
    ids = named.select(key.alias("_row"), F.col("doc_id").cast("long").alias("_id")).join(small(copies, SMALL_CANDIDATES), "_row")
    first = ids.groupBy("_c").agg(F.min(F.struct("_id", "_row")).alias("x")).select("x._row")
    gone = written(copies.join(first, "_row", "left_anti").select("_row"), "gone")
    same = F.col("doc_id").isNotNull() & (key == F.col(row))
    kept = docs.join(small(gone.withColumnRenamed("_row", row), SMALL_CANDIDATES), same, "left_anti")
    repeated = written(found.groupBy("_row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_row"), "repeated-rows")
    if repeated.isEmpty():
        return kept
    repeated = small(repeated.withColumnRenamed("_row", row), SMALL_CANDIDATES)
    order = Window.partitionBy(key).orderBy(F.to_json(F.struct(*map(quoted, docs.columns))))
    one = kept.join(repeated, same, "left_semi").withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).drop(place)
    return kept.join(repeated, same, "left_anti").unionByName(one)
