"""Rollups of places, sights, clusters and data quality, as grouped aggregates with partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions import scores
from gleaner.functions.taxonomy import VALID_L1
from gleaner.functions.text import minutes, strip
from gleaner.operators.sampling import most_common

#: Fixed buckets, reported with zeros.
TIERS = ["A", "B", "C"]
SENTIMENTS = ["positive", "negative", "neutral", "mixed"]
INTENTS = ["warning", "recommendation", "explanation", "comparison", "history", "description"]
SOURCES = ["tripadvisor_review", "google_review", "reddit_post", "reddit_comment", "youtube_transcript_chunk"]


def bucket_counts(value: str, buckets: list[str], prefix: str) -> list[Column]:
    return [F.count_if(F.col(value) == b).alias(f"{prefix}_{b}") for b in buckets]


def poi_stats(clusters: DataFrame, insights: DataFrame, place: str = "poi_name", l1: list[str] | None = None, sources: list[str] | None = None) -> DataFrame:
    """A row per place that has clusters or insights: totals, zero-filled bucket counts and the verdict score."""
    c = clusters.groupBy(place).agg(F.count(F.lit(1)).alias("total_clusters"), *bucket_counts("quality_tier", TIERS, "tier"))
    i = insights.groupBy(place).agg(
        F.count(F.lit(1)).alias("total_insights"),
        *bucket_counts("insight_sentiment", SENTIMENTS, "sentiment"),
        *bucket_counts("intent_tag", INTENTS, "intent"),
        *bucket_counts("l1", l1 or VALID_L1, "l1"),
        *bucket_counts("source", sources or SOURCES, "source"),
    )
    both = c.join(i, place, "full_outer")
    both = both.na.fill(0, [x for x in both.columns if x != place])
    col = F.col
    return both.withColumn("verdict_score", scores.verdict(col("tier_A"), col("total_clusters"), col("sentiment_positive"), col("intent_warning"), col("total_insights")))


def sub_attractions(insights: DataFrame, min_mentions: int = 2, place: str = "poi_name", order: str = "flat_idx") -> DataFrame:
    """A row per place and sight with at least ``min_mentions``: counts, the exact median of the minutes it takes, and the
    commonest clusters and intents.  Sorted by mentions."""
    key = [place, "sub_attraction"]
    own = insights.withColumn("sub_attraction", strip(F.coalesce("sub_attraction", F.lit("")))).filter("sub_attraction <> ''")
    time = F.transform(F.coalesce("numeric_anchors", F.array().cast("array<string>")), minutes)
    times = own.select(*key, F.explode(time).alias("m")).filter("m IS NOT NULL").groupBy(*key).agg(F.median("m").alias("avg_minutes"))
    stats = own.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_insights"),
        F.count_distinct(F.nullif("source", F.lit(""))).alias("n_sources"),
        F.count_if(F.col("insight_sentiment") == "positive").alias("positive_count"),
        F.count_if(F.col("insight_sentiment") == "negative").alias("negative_count"),
        F.count_if(F.col("intent_tag") == "warning").alias("warning_count"),
        F.count_if(F.col("intent_tag") == "recommendation").alias("recommendation_count"),
    ).filter(F.col("n_insights") >= min_mentions)

    def top(value: str, k: int, name: str) -> DataFrame:
        ranked = most_common(own.filter(F.col(value).cast("string") != ""), key, value, order, k)
        return ranked.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", value, "n"))).alias(name))

    clusters = top("cluster_id", 3, "c").select(*key, F.col("c.cluster_id").alias("sample_cluster_ids"))
    intents = top("intent_tag", 5, "t").select(*key, F.map_from_arrays("t.intent_tag", "t.n").alias("top_intent_tags"))
    out = stats.join(times, key, "left").join(clusters, key, "left").join(intents, key, "left")
    return out.orderBy(F.desc("n_insights"), place, "sub_attraction")


def poi_summary(clusters: DataFrame, place: str = "poi_name") -> DataFrame:
    """Clusters, insights, good clusters and the sorted sources of each place; ``source_mix`` maps sources to counts."""
    names = clusters.select(place, F.explode(F.map_keys("source_mix")).alias("s")).groupBy(place).agg(F.array_sort(F.collect_set("s")).alias("sources"))
    stats = clusters.groupBy(place).agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("size").alias("n_insights"), F.count_if(F.col("quality_tier") == "A").alias("n_tier_a"))
    return stats.join(names, place, "left")


def health(clusters: DataFrame, insights: DataFrame, allowed: list[str] | None = None, place: str = "poi_name") -> DataFrame:
    """One row: store sizes and the places, those allowed if a list is given."""
    own = clusters.select(place).distinct()
    own = own.filter(F.col(place).isin(allowed)) if allowed else own
    pois = own.agg(F.array_sort(F.collect_set(place)).alias("pois"))
    return clusters.agg(F.count(F.lit(1)).alias("n_clusters")).join(insights.agg(F.count(F.lit(1)).alias("n_insights"))).join(pois)


def source_mix(members: DataFrame, cluster: str = "cluster_id", source: str = "source") -> DataFrame:
    """size, source_mix and n_sources of each cluster, by counts per source first."""
    counts = members.groupBy(cluster, source).agg(F.count(F.lit(1)).alias("n"))
    mix = F.map_from_entries(F.array_sort(F.collect_list(F.struct(source, "n"))))
    return counts.groupBy(cluster).agg(F.sum("n").alias("size"), mix.alias("source_mix"), F.count(F.lit(1)).alias("n_sources"))


def diversity_profile(clusters: DataFrame) -> DataFrame:
    """How many clusters have each number of sources."""
    return clusters.groupBy("n_sources").agg(F.count(F.lit(1)).alias("n_clusters"))


def corroborated_share(clusters: DataFrame, place: str = "poi_name") -> DataFrame:
    return clusters.groupBy(place).agg(F.avg((F.col("n_sources") >= 2).cast("double")).alias("share"))


def drop_report(rows: DataFrame, reason: Column, place: str) -> tuple[DataFrame, DataFrame]:
    """Counts of each place's drop reasons, and its rows in, rows out and share kept in per cent."""
    own = rows.withColumn("reason", reason)
    reasons = own.filter("reason IS NOT NULL").groupBy(place, "reason").agg(F.count(F.lit(1)).alias("n"))
    kept = F.count_if(F.col("reason").isNull())
    totals = own.groupBy(place).agg(F.count(F.lit(1)).alias("n_in"), kept.alias("n_out"), F.round(100 * kept / F.count(F.lit(1)), 1).alias("kept_pct"))
    return reasons, totals


def distribution(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def label_profile(df: DataFrame, low: float = 0.65) -> DataFrame:
    """Counts, mean confidence and how many are unsure, for each l1 and l2, each l1 and all."""
    return df.rollup("l1", "l2").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("avg_confidence"), F.count_if(F.col("confidence") < low).alias("n_low"))


def tag_counts(df: DataFrame, tags: str, k: int) -> DataFrame:
    """The commonest k values of an array column, ties by value."""
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(k)


def completeness(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, n_filled and ratio of each column, in one pass."""
    sums = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(f)).alias(f) for f in fields])
    pairs = F.stack(F.lit(len(fields)), *[x for f in fields for x in (F.lit(f), F.col(f))]).alias("field", "n_filled")
    return sums.select("_n", pairs).select("field", "n_filled", F.coalesce(F.col("n_filled") / F.nullif("_n", F.lit(0)), F.lit(0.0)).alias("ratio"))


def middle_pick(values: Column, descending: bool = False) -> Column:
    """The element at half the length of the sorted values, the upper of two middles."""
    own = F.sort_array(F.array_compact(values), asc=not descending)
    return F.get(own, F.floor(F.size(own) / 2).cast("int"))


def provenance(links: DataFrame, url: str, intent: str) -> DataFrame:
    """The intents by which each address was found, the most first; several are ``multi``."""
    out = links.groupBy(url).agg(F.array_sort(F.collect_set(intent)).alias("intents"), F.count(F.lit(1)).alias("n_paths"))
    return out.withColumn("multi", F.size("intents") > 1).orderBy(F.desc("n_paths"), url)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def accuracy(results: DataFrame) -> DataFrame:
    """Checks that passed, in number and per cent."""
    return results.agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("n_passed"), F.round(100 * F.avg(F.col("passed").cast("double")), 1).alias("pct"))


def shares(df: DataFrame, place: str, value: str) -> DataFrame:
    """Counts of each value and its per cent of the place's rows."""
    n = df.groupBy(place, value).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(place)), 1))


def extraction_summary(results: DataFrame, source: str = "source") -> DataFrame:
    """Rows, insights, discarded rows and errors of each source."""
    n = F.coalesce(F.size("insights"), F.lit(0))
    return results.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.greatest(n, F.lit(0))).alias("n_insights"),
        F.count_if((n <= 0) & F.col("error").isNull()).alias("n_discarded"),
        F.count_if(F.col("error").isNotNull()).alias("n_errors"),
    )
