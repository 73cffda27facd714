"""Binding views: the synthetic tables in the roles of insights, clusters, raw rows, threads and links.

Each is one SELECT that Spark and other engines read alike, so queries and their SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.storage import bound_batches

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels", "conversations", "benchmark")


def _pick(expr: str, values: list[str]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


_SOURCES = ["tripadvisor_review", "google_review", "reddit_post", "reddit_comment", "youtube_transcript_chunk"]
_L1 = ["Visit Intelligence", "Attention Intelligence", "Discovery Intelligence", "Culinary Intelligence", "Operational Intelligence"]
_SENTIMENTS = ["positive", "negative", "neutral", "mixed"]
_INTENTS = ["warning", "recommendation", "explanation", "comparison", "history", "description", "other"]
_TIER = "CASE WHEN size % 9 >= 5 OR size >= 36 THEN 'A' WHEN size % 9 >= 2 THEN 'B' ELSE 'C' END"

VIEWS = {
    "insights": f"""
SELECT event_id AS flat_idx, concat('place', CAST(user_id % 4 AS STRING)) AS poi_name,
  {_pick("event_id % 5", _SOURCES)} AS source, CAST(event_id % 977 AS STRING) AS source_id,
  {_pick("event_id % 5", _L1)} AS l1, concat('topic', CAST(event_id % 3 AS STRING)) AS l2,
  {_pick("(event_id * 7 + user_id) % 4", _SENTIMENTS)} AS insight_sentiment, CAST(NULL AS STRING) AS sentiment,
  {_pick("(event_id + user_id) % 7", _INTENTS)} AS intent_tag, event_type AS sub_attraction,
  concat(CAST(CAST(floor(abs(value)) AS INT) AS STRING), CASE WHEN event_id % 3 = 0 THEN ' hours' ELSE ' min' END) AS anchor,
  CAST(event_id % 5 + 1 AS INT) AS rating, event_id % 100 / 100.0 AS freshness_score, event_id % 50 AS cluster_id, ts
FROM events""",
    "clusters": f"""
SELECT *, {_TIER} AS quality_tier FROM (
SELECT vec_id AS cluster_id, concat('place', CAST(label % 4 AS STRING)) AS poi_name, concat('cluster ', CAST(vec_id AS STRING)) AS name,
  CAST(vec_id % 40 + 1 AS INT) AS size, CAST(vec_id % 6 + 1 AS INT) AS n_sources,
  {_pick("vec_id % 5", _L1)} AS l1, {_pick("(vec_id + label) % 5", _L1)} AS secondary_l1, concat('topic', CAST(vec_id % 3 AS STRING)) AS l2,
  concat('detail', CAST(vec_id % 7 AS STRING)) AS l3, {_pick("vec_id % 4", _SENTIMENTS)} AS sentiment,
  concat('anchor', CAST(vec_id % 11 AS STRING)) AS anchor, embedding, label
FROM embeddings) c""",
    "raw": f"""
SELECT doc_id AS raw_order, {_pick("doc_id % 5", _SOURCES)} AS source, CAST(doc_id AS STRING) AS source_id, text,
  CAST(doc_id % 5 + 1 AS INT) AS rating, concat('https://example.org/', CAST(doc_id AS STRING)) AS source_url, lang AS language
FROM documents""",
    "videos": """
SELECT o_orderkey AS video_id, CAST(floor(o_totalprice) AS BIGINT) AS views, o_custkey % 9000 AS likes, o_orderkey % 700 AS comment_count,
  CAST(o_orderkey % 600 AS INT) AS duration_seconds, CASE WHEN o_orderkey % 600 <= 60 THEN 'short' ELSE 'long' END AS format, o_custkey AS poi_id
FROM orders""",
    "members": f"SELECT label AS cluster_id, vec_id AS flat_idx, {_pick('vec_id % 5', _SOURCES)} AS source FROM embeddings",
}


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    bound_batches(spark)
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A binding view over the tables that it names."""
    import re

    sql = VIEWS[name]
    used = [t for t in TABLES if re.search(rf"\bFROM {t}\b", sql)]
    return spark.sql(re.sub(r"\bFROM (\w+)\b", r"FROM {\1}", sql), **tables(spark, sf_dir, *used))


def with_views(sql: str, *names: str) -> str:
    """SQL with the binding views as common table expressions."""
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    own = sql.strip()
    if own[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {head},\n{own[14:]}"
    return f"WITH {head},\n{own[5:]}" if own[:5].upper() == "WITH " else f"WITH {head}\n{own}"
