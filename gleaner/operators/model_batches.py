"""Rows sent to a language model in batches: naming, scoring, labelling, tagging, and free labels of single rows.

A batch is one call, and a task keeps up to ``parallel`` calls in flight, whose rows come out in order.  A call that fails after
its attempts turns its batch's rows into rows with their error and the defaults of the operator; an answer that can't be read
does so for its own row alone.  No row is lost and none is doubled.

With a folder of ``answers`` calls are resumable: what the model said is stored under a digest of what it was asked, a job for each
wave of rows.  Rows that have an answer there aren't asked again, equal rows are asked once, failures are asked again by
the next run.  A job that fails loses the wave that it was in.  Rules over the answers (tiers, recovery of labels, known
values) are columns.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any, TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from gleaner.functions import scores, taxonomy
from gleaner.models import JsonModel, call_with_retries

Row = dict[str, Any]
In, Out = TypeVar("In"), TypeVar("Out")
#: Calls in flight in a task, and rows of a wave, which a failure can lose.
PARALLEL, WAVE = 8, 100_000
_ANSWERS = "digest string, said string, error string, run string, wave int"


class RuleModel:
    """A stand-in: the prompt's JSON rows through a rule, under the answer's field."""

    def __init__(self, field: str, rule: Callable[[Row], Row]):
        self.field, self.rule = field, rule

    def call(self, system: str, user: str) -> dict:
        return {self.field: [self.rule(r) for r in json.loads(user)]}


def json_prompt(rows: list[Row]) -> str:
    return json.dumps(rows, ensure_ascii=False, default=str)


def matched(rows: list[Row], said: Any, key: str, by_place: bool = False) -> list[Row]:
    """The answer's object of each row: that of its key, of repeated ones the last; else, if places count, the one at its
    place; else an empty one."""
    found = said if isinstance(said, list) else []
    by_key = {str(s[key]): s for s in found if isinstance(s, dict) and s.get(key) is not None}
    at = lambda k: found[k] if by_place and k < len(found) and isinstance(found[k], dict) else {}
    return [by_key.get(str(r[key])) or at(k) for k, r in enumerate(rows)]


def in_order(work: Callable[[In], Out], items: Iterator[In], parallel: int) -> Iterator[Out]:
    """The results of ``work`` in the order of ``items``, of which up to ``parallel`` are taken ahead."""
    window: deque = deque()
    with ThreadPoolExecutor(parallel) as pool:
        for item in items:
            window.append(pool.submit(work, item))
            if len(window) == parallel:
                yield window.popleft().result()
        while window:
            yield window.popleft().result()


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[Row]]:
    """The rows of a partition, ``size`` at a time, across its batches."""
    rows: list[Row] = []
    for b in batches:
        for r in b.to_pylist():
            rows.append(r)
            if len(rows) == size:
                yield rows
                rows = []
    if rows:
        yield rows


class _Call:
    """One call for some rows as the prompt shows them, and what it says of each."""

    def __init__(self, model: JsonModel, system: str, field: str, read: Callable[[Row], Row], key: str, by_place: bool, numbered: bool, prompt: Callable[[list[Row]], str], attempts: int, wait: float):
        self.model, self.system, self.field, self.read, self.key = model, system, field, read, key
        self.by_place, self.numbered, self.prompt, self.attempts, self.wait = by_place, numbered, prompt, attempts, wait

    def said(self, shown: list[Row]) -> list[tuple[Row | None, str | None]]:
        """The object that came back for each row, or its error."""
        try:
            back = call_with_retries(self.model, self.system, self.prompt(shown), self.attempts, self.wait).get(self.field)
            found = matched(shown, back, self.key, self.by_place)
        except Exception as e:
            return [(None, _error(e))] * len(shown)
        return [(s, self.values(s)[1]) for s in found]

    def values(self, said: Row) -> tuple[Row | None, str | None]:
        """The columns that an object is read to, or the error of reading it."""
        try:
            return self.read(said), None
        except Exception as e:
            return None, _error(e)


def _error(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def _digest(call: _Call, columns: str, shown: Row) -> str:
    """Of what a row is asked: the instructions, the answer's form and the row as shown, without its place."""
    return hashlib.sha256("\0".join([call.system, call.field, columns, json_prompt([shown])]).encode("utf-8", "surrogatepass")).hexdigest()


def stored(spark: SparkSession, answers: str) -> DataFrame:
    """The answers in a folder: digest, said (JSON), error, run and wave."""
    spark.createDataFrame([], _ANSWERS).write.mode("append").partitionBy("run", "wave").parquet(answers)  # the folder, to be read from
    return spark.read.schema(_ANSWERS).parquet(answers)


def _answer(keyed: DataFrame, call: _Call, batch: int, parallel: int, answers: str, wave: int) -> DataFrame:
    """Asks for the rows (digest, shown) that have no answer yet, wave by wave; digest, said and error of all rows."""
    spark, own = keyed.sparkSession, uuid.uuid4().hex
    known = stored(spark, answers).filter("error IS NULL").select("digest")
    asked = keyed.select("digest", "shown").dropDuplicates(["digest"])
    waves = -(-asked.join(known, "digest", "left_anti").count() // wave)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(rows: list[Row]) -> pa.RecordBatch:
            shown = [json.loads(r["shown"]) for r in rows]
            if call.numbered:  # by the place in this batch
                shown = [{**s, call.key: k} for k, s in enumerate(shown)]
            said = [(r["digest"], json.dumps(s, ensure_ascii=False) if e is None else None, e) for r, (s, e) in zip(rows, call.said(shown), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*said, strict=True)], names=["digest", "said", "error"])

        yield from in_order(one, _pieces(batches, batch), parallel)

    for k in range(waves):
        # Read anew: an earlier wave's answers are there.
        known = stored(spark, answers).filter("error IS NULL").select("digest")
        mine = asked.filter(F.pmod(F.xxhash64("digest"), F.lit(waves)) == k).join(known, "digest", "left_anti")
        mine.mapInArrow(run, "digest string, said string, error string").write.parquet(f"{answers}/run={own}/wave={k}")
    every = stored(spark, answers)
    good = every.filter("error IS NULL").groupBy("digest").agg(F.min("said").alias("said"), F.lit(None).cast("string").alias("error"))
    bad = every.filter((F.col("run") == own) & F.col("error").isNotNull()).select("digest", "said", "error")
    return good.unionByName(bad)


def ask(
    df: DataFrame, model: JsonModel, system: str, field: str, asked: Callable[[Row, int], Row], read: Callable[[Row], Row], columns: str,
    batch: int, key: str, by_place: bool = False, numbered: bool = False, prompt: Callable[[list[Row]], str] = json_prompt, attempts: int = 3, wait: float = 2.0,
    parallel: int = PARALLEL, answers: str | None = None, wave: int = WAVE,
) -> DataFrame:
    """``df`` with ``columns`` and ``error``, from one call for each ``batch`` rows of a partition.

    ``asked`` is what the prompt shows of a row and its place, which is its ``key`` where rows are ``numbered``; ``read`` turns the object that came back for it into the
    columns.  Failed rows have nulls there.  Columns of ``df`` that have such a name are replaced.  With ``answers`` the calls are
    made at once, and their answers kept in that folder for later runs; else they are made when the result is computed."""
    if parallel < 1 or batch < 1 or wave < 1:
        raise ValueError("at least one call, row of a batch and row of a wave")
    new = StructType.fromDDL(columns)
    kept = df.drop(*new.names, "error")
    schema = StructType([*kept.schema.fields, *new.fields, StructField("error", StringType())])
    arrow, none = to_arrow_schema(schema), dict.fromkeys(new.names)
    call = _Call(model, system, field, read, key, by_place, numbered, prompt, attempts, wait)

    def filled(rows: list[Row], said: list[tuple[Row | None, str | None]]) -> pa.RecordBatch:
        out = []
        for r, (s, error) in zip(rows, said, strict=True):
            values, error = (None, error) if error else call.values(s)
            out.append({**r, **(values or none), "error": error})
        return pa.RecordBatch.from_pylist(out, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_order(lambda rows: filled(rows, call.said([asked(r, k) for k, r in enumerate(rows)])), _pieces(batches, batch), parallel)

    if answers is None:
        return kept.mapInArrow(run, schema)

    digest, text = (next(n for n in (f"_{name}_{k}" for k in range(len(kept.columns) + 1)) if n not in kept.columns) for name in ("digest", "shown"))
    with_shown = StructType([*kept.schema.fields, StructField(digest, StringType()), StructField(text, StringType())])
    wide = to_arrow_schema(with_shown)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shown = [asked(r, 0) for r in b.to_pylist()]
            columns_ = [pa.array([_digest(call, columns, s) for s in shown], pa.string()), pa.array([json_prompt([s])[1:-1] for s in shown], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns_], schema=wide)

    keyed = kept.mapInArrow(keys, with_shown)
    said = _answer(keyed.select(F.col(digest).alias("digest"), F.col(text).alias("shown")), call, batch, parallel, answers, wave)
    said = said.select(F.col("digest").alias(digest), F.col("said").alias(text), "error")
    both = keyed.drop(text).join(said, digest, "left").drop(digest)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            said = [(json.loads(s) if s is not None else None, e) for s, e in ((r.pop(text), r.pop("error")) for r in rows)]
            yield filled(rows, said)

    return both.mapInArrow(fill, schema)


def _text(s: Row, name: str, default: str | None = "") -> str | None:
    return str(s.get(name) or "").strip() or default


def _texts(s: Row, name: str) -> list[str]:
    return [str(x) for x in s.get(name) or [] if x is not None]


def score(clusters: DataFrame, model: JsonModel, system: str = "", batch: int = 20, **calls) -> DataFrame:
    """Two scores of 1 to 5, their maximum as ``specificity``, a sentiment and a tier; a score that is missing or 0 is 3.
    Clusters without an answer have 3, 3, neutral and tier C."""

    def read(s: Row) -> Row:
        one = lambda name: int(s.get(name, s.get("specificity", 3)) or 3)
        return {"named_entity_score": one("named_entity_score"), "actionability_score": one("actionability_score"), "sentiment": _text(s, "sentiment", "neutral"), "score_reasoning": _text(s, "reasoning")}

    def asked(r: Row, k: int) -> Row:
        return {c: r[c] for c in ("cluster_id", "name", "size")}

    out = ask(clusters, model, system, "scores", asked, read, "named_entity_score int, actionability_score int, sentiment string, score_reasoning string", batch, "cluster_id", **calls)
    a, b = (F.coalesce(c, F.lit(3)) for c in ("named_entity_score", "actionability_score"))
    tier = F.when(F.col("error").isNotNull(), "C").otherwise(scores.quality_tier(a, b, F.col("size")))
    return out.withColumns({"named_entity_score": a, "actionability_score": b, "specificity": F.greatest(a, b), "sentiment": F.coalesce("sentiment", F.lit("neutral")), "quality_tier": tier})


def label(clusters: DataFrame, model: JsonModel, combos: DataFrame, system: str = "", batch: int = 20, **calls) -> DataFrame:
    """l1, l2, l3, secondary_l1, label_confidence, label_reasoning and label_valid.

    An invalid triple is recovered where its l1 is known, with a confidence of 0.5 at most; a famous sight labelled a
    hidden highlight is overridden after that.  Clusters without an answer have empty, invalid labels and confidence 0."""

    def read(s: Row) -> Row:
        return {"l1": _text(s, "l1"), "l2": _text(s, "l2"), "l3": _text(s, "l3"), "secondary_l1": _text(s, "secondary_l1", None), "label_confidence": float(s.get("confidence", 0.7) or 0.7), "label_reasoning": _text(s, "reasoning")}

    def asked(r: Row, k: int) -> Row:
        return {c: r.get(c) for c in ("cluster_id", "poi_name", "name", "size", "named_entity_score", "actionability_score", "specificity", "sentiment", "polarity", "anchor_entities", "n_sources")} | {"source_mix": dict(r.get("source_mix") or {})}

    out = ask(clusters, model, system, "labels", asked, read, "l1 string, l2 string, l3 string, secondary_l1 string, label_confidence double, label_reasoning string", batch, "cluster_id", **calls)
    blank = {c: F.coalesce(c, F.lit("")) for c in ("l1", "l2", "l3", "label_reasoning")}
    out = taxonomy.recover(out.withColumns({**blank, "label_confidence": F.coalesce("label_confidence", F.lit(0.0))}), combos)
    noted = lambda when, text: F.when(when, F.trim(F.concat("label_reasoning", F.lit(text)))).otherwise(F.col("label_reasoning"))
    moved = F.col("label_recovered")
    out = out.withColumns({"label_confidence": F.when(moved, F.least("label_confidence", F.lit(0.5))).otherwise(F.col("label_confidence")), "label_reasoning": noted(moved, " [auto-recovered]"), "label_valid": F.col("label_valid") | moved, "_l2": F.col("l2")})
    out = taxonomy.override_famous(out)
    famous = F.col("l2") != F.col("_l2")
    # The triples of the override are among the fixed ones of every taxonomy.
    return out.withColumns({"label_reasoning": noted(famous, " [famous-anchor-override]"), "label_valid": F.col("label_valid") | famous}).drop("_l2", "label_recovered")


def tag(rows: DataFrame, model: JsonModel, system: str = "", batch: int = 10, **calls) -> DataFrame:
    """Sentiment, intent, numeric anchors, sub-attraction and visit date of insights, with known values only.  Rows are
    numbered within their batch; an answer counts by number, else by place.  Rows without an answer have neutral, other, no values."""
    from gleaner.sources.parsers import sane_tag

    names = ["insight_sentiment", "intent_tag", "numeric_anchors", "sub_attraction", "visit_date_mentioned"]

    def read(s: Row) -> Row:
        return {n: _texts(s, n) if n == "numeric_anchors" else _text(s, n, None) for n in names}

    def asked(r: Row, k: int) -> Row:
        return {"id": k, "cluster": r.get("cluster_name") or "(no cluster)", "text": (r["text"] or "").replace("\n", " ").strip()}

    columns = "insight_sentiment string, intent_tag string, numeric_anchors array<string>, sub_attraction string, visit_date_mentioned string"
    out = ask(rows, model, system, "results", asked, read, columns, batch, "id", by_place=True, numbered=True, **calls)
    return out.withColumn("_tag", sane_tag(F.struct(*names))).withColumns({n: F.col("_tag")[n] for n in names}).drop("_tag")


def name(clusters: DataFrame, insights: DataFrame, model: JsonModel, system: str = "", **calls) -> DataFrame:
    """name, anchor_entities, polarity and name_confidence of clusters, a call for each, which sees the texts nearest to its
    centre in order.  A failed call names the cluster by the nearest text, without anchors or polarity, confidence 0."""
    near = clusters.select("cluster_id", F.posexplode("centroid_text_indices").alias("place", "flat_idx"))
    texts = near.join(insights.select("flat_idx", F.struct("source", "text").alias("said")), "flat_idx").groupBy("cluster_id")
    texts = texts.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "said"))), lambda x: x["said"]).alias("_texts"))

    def read(s: Row) -> Row:
        return {"name": _text(s, "cluster_name"), "anchor_entities": _texts(s, "anchor_entities"), "polarity": _text(s, "polarity", "neutral").lower(), "name_confidence": float(s.get("confidence", 0.7) or 0.7)}

    def asked(r: Row, k: int) -> Row:
        return {"cluster_id": r["cluster_id"], "poi_name": r["poi_name"], "size": r["size"], "insights": r["_texts"] or []}

    out = ask(clusters.join(texts, "cluster_id", "left"), model, system, "names", asked, read, "name string, anchor_entities array<string>, polarity string, name_confidence double", 1, "cluster_id", by_place=True, **calls)
    first: Column = F.coalesce(F.get("_texts", F.lit(0))["text"], F.lit(""))
    failed = F.col("error").isNotNull()
    fallback = {"name": F.when(failed, first).otherwise(F.col("name")), "anchor_entities": F.coalesce("anchor_entities", F.array().cast("array<string>")), "name_confidence": F.coalesce("name_confidence", F.lit(0.0))}
    return out.withColumns(fallback).drop("_texts")


def label_rows(rows: DataFrame, model: JsonModel, system: str = "", **calls) -> DataFrame:
    """Single raw rows with a model's whole answer as JSON in ``output``, or none and the error."""

    def asked(r: Row, k: int) -> Row:
        return {"place": k, "poi_name": r["poi_name"] or "(unknown POI)", "city": r["city"] or "", "source": r["source"], "text": r["text"]}

    def read(s: Row) -> Row:
        return {"output": json.dumps(s, ensure_ascii=False, sort_keys=True)}

    return ask(rows, model, system, "output", asked, read, "output string", 1, "place", by_place=True, numbered=True, **calls)
