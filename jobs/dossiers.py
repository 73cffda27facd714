"""Dossiers of places: the verdict, the sights, what to see and what to beware of, each with quotes, as one table by place.

    spark-submit jobs/dossiers.py --config jobs/dossiers.json

All places are one plan.  The output is partitioned by place; a run of all places replaces it, a run of some ``places`` replaces
theirs and leaves the others, so any run can be repeated.  Rows of a place: ``section`` (verdict, sights, highlights, concerns),
``rank`` in it, ``item`` with its number ``n`` and ``score``, and ``quotes``.
"""

from __future__ import annotations

import logging
import os
import sys
from dataclasses import dataclass, field

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import scores
from gleaner.operators import cleaning, joins, rollups
from gleaner.operators.sampling import top_per_group
from gleaner.plans.bindings import view
from jobs.common import main

log = logging.getLogger("gleaner.jobs.dossiers")

DOSSIERS = "section string, rank int, item string, n long, score double, quotes array<struct<source:string,source_id:string,rating:int,text:string>>, poi_name string"


@dataclass(frozen=True)
class Settings:
    """``input`` is the folder of the given tables; an empty list of places means all."""

    input: str
    output: str
    places: list[str] = field(default_factory=list)
    per_section: int = 10
    quotes: int = 3
    min_mentions: int = 2


def _clusters(spark: SparkSession, path: str) -> DataFrame:
    c = F.col("cluster_id")
    return view(spark, path, "clusters").withColumns({"centroid_text_indices": F.array(c * 3), "member_indices": F.array(c, c + 1, c + 5, c + 10, c + 7)})


def _insights(spark: SparkSession, path: str) -> DataFrame:
    return view(spark, path, "insights").withColumns({"numeric_anchors": F.array("anchor"), "anchor_entity": F.col("anchor")})


def dossiers(clusters: DataFrame, insights: DataFrame, raw: DataFrame, per_section: int = 10, quotes: int = 3, min_mentions: int = 2, places: list[str] | None = None) -> DataFrame:
    """The rows of ``DOSSIERS`` of every place that has clusters or insights, or of the named places.

    A cluster's quotes come from its members, whichever place they name."""
    every = insights
    if places:
        clusters, insights = (df.filter(F.col("poi_name").isin(places)) for df in (clusters, insights))
    none = F.array().cast("array<struct<source:string,source_id:string,rating:int,text:string>>")
    stats = rollups.poi_stats(clusters, insights)
    verdict = stats.select("poi_name", F.lit("verdict").alias("section"), F.lit(1).alias("rank"), scores.verdict_headline(F.col("verdict_score"), F.col("poi_name")).alias("item"), F.col("total_insights").alias("n"), F.col("verdict_score").cast("double").alias("score"), none.alias("quotes"))
    sights = top_per_group(rollups.sub_attractions(insights, min_mentions), ["poi_name"], [F.desc("n_insights"), F.asc("sub_attraction")], per_section)
    praise = F.round(F.col("positive_count") / F.col("n_insights"), 6)
    sights = sights.select("poi_name", F.lit("sights").alias("section"), "rank", F.col("sub_attraction").alias("item"), F.col("n_insights").alias("n"), praise.alias("score"), none.alias("quotes"))

    diverse = F.coalesce("n_sources", F.lit(1))
    good = clusters.filter("quality_tier = 'A' AND sentiment = 'positive'").withColumn("score", F.round(scores.hybrid(F.lit(1.0), F.col("quality_tier"), diverse, F.coalesce("size", F.lit(0))), 9))
    bad = clusters.filter(cleaning.has_intent("Operational Intelligence") & F.col("sentiment").isin("negative", "mixed")).withColumn("score", F.coalesce("size", F.lit(0)) * scores.diversity(diverse))
    chosen = None
    for section, rows in (("highlights", good), ("concerns", bad)):
        own = top_per_group(rows, ["poi_name"], [F.desc("score"), F.asc("cluster_id")], per_section).withColumn("section", F.lit(section))
        own = own.select("section", "rank", "poi_name", "cluster_id", "name", "size", F.round("score", 6).alias("score"), "centroid_text_indices", "member_indices")
        chosen = own if chosen is None else chosen.unionByName(own)
    # Only the chosen clusters' members look for quotes; a cluster of both sections is asked for once.
    asked = chosen.select("cluster_id", "centroid_text_indices", "member_indices").dropDuplicates(["cluster_id"])
    said = joins.evidence(asked, every, raw, quotes)
    one = F.struct("rank", F.struct("source", "source_id", F.col("rating").cast("int").alias("rating"), F.col("raw_text").alias("text")).alias("quote"))
    said = said.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["quote"]).alias("quotes"))
    chosen = chosen.join(said, "cluster_id", "left").select("poi_name", "section", "rank", F.col("name").alias("item"), F.col("size").cast("long").alias("n"), "score", F.coalesce("quotes", none).alias("quotes"))
    return verdict.unionByName(sights).unionByName(chosen)


def read(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(DOSSIERS).parquet(output)


def run(spark: SparkSession, settings: Settings) -> None:
    """Writes the dossiers of all places, or of those named."""
    clusters, insights, raw = _clusters(spark, settings.input), _insights(spark, settings.input), view(spark, settings.input, "raw")
    rows = dossiers(clusters, insights, raw, settings.per_section, settings.quotes, settings.min_mentions, settings.places)
    log.info("reading clusters, insights and raw rows from %s, places: %s", settings.input, settings.places or "all")
    out = rows.repartition("poi_name").sortWithinPartitions("poi_name", "section", "rank").write.partitionBy("poi_name")
    # Of all places the old ones go; of some places only their partitions are replaced.
    out.mode("overwrite").option("partitionOverwriteMode", "dynamic" if settings.places else "static").parquet(settings.output)
    n, places = read(spark, settings.output).agg(F.count(F.lit(1)), F.count_distinct("poi_name")).head()
    log.info("%s holds %d rows of %d places", settings.output, n, places)


if __name__ == "__main__":
    main(Settings, run, "Writes dossiers of places.")
