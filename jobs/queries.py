"""The jobs as registered queries: each runs twice into one folder, and its whole output is read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.plans import catalog
from gleaner.plans.bindings import with_views
from gleaner.storage import shared_folder
from jobs import dossiers, intake


def job1_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared_folder(spark, "job1")
    # The star matches a table of one file as well as one of many.
    settings = intake.Settings(f"{sf_dir}/documents.parquet*", f"{at}/out", f"{at}/checkpoint")
    for _ in range(2):
        intake.run(spark, settings)
    return intake.ledger(spark, settings.output)


def job2_dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = dossiers.Settings(sf_dir, shared_folder(spark, "job2"))
    for _ in range(2):
        dossiers.run(spark, settings)
    said = F.array_join(F.transform("quotes", lambda q: F.concat_ws(":", q["source"], q["source_id"], q["rating"].cast("string"))), "|")
    return dossiers.read(spark, settings.output).withColumn("quotes", said)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_intake": job1_intake, "job2_dossiers": job2_dossiers}

_JOB1 = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(nullif(lang, ''), 'en') AS language, coalesce(text, '') AS text FROM documents
), r AS (
  SELECT *, {catalog._REASON} AS reason FROM d
), k AS (
  SELECT text, min(doc_id) AS doc_id, true AS fresh FROM r WHERE reason IS NULL GROUP BY text
), x AS (
  SELECT r.*, coalesce(reason, CASE WHEN fresh THEN 'kept' ELSE 'repeated' END) AS decision FROM r LEFT JOIN k USING (doc_id, text)
), p AS (
  SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM x WHERE decision = 'kept'
), s AS (
  SELECT doc_id, i, regexp_replace(parts[i], '^\s+|\s+$', '', 'g') AS t FROM p, LATERAL (SELECT unnest(range(1, len(p.parts) + 1)) AS i)
), w AS (
  -- Letters beyond ASCII are letters of words.
  SELECT *, regexp_replace(lower(t), '[^\x00-\x7F]', 'x', 'g') AS low FROM s WHERE len(regexp_extract_all(t, '\S+')) >= 4
), tagged AS (
  SELECT *, regexp_matches(low, '\b(avoid|scam|rude|bad|dirty)\b') AS bad, regexp_matches(low, '\b(great|love|best|amazing)\b') AS good,
         regexp_matches(low, '\b(should|must|recommend)\b') AS should, len(regexp_extract_all(lower(t), '\d+(?:[.,]\d+)?\s*\w+')) AS numbers FROM w
), a AS (
  SELECT doc_id, count(*) AS n_insights, count(*) FILTER (good AND NOT bad) AS n_positive, count(*) FILTER (bad AND NOT good) AS n_negative,
         count(*) FILTER (bad AND good) AS n_mixed, count(*) FILTER (bad) AS n_warning, count(*) FILTER (should AND NOT bad) AS n_recommendation,
         sum(numbers)::BIGINT AS n_numbers, sha256(string_agg(t, chr(10) ORDER BY i)) AS insights_sha256 FROM tagged GROUP BY doc_id
)
SELECT doc_id, source, language, decision, length(text)::INT AS n_chars, coalesce(n_insights, 0) AS n_insights, coalesce(n_positive, 0) AS n_positive,
       coalesce(n_negative, 0) AS n_negative, coalesce(n_mixed, 0) AS n_mixed, coalesce(n_warning, 0) AS n_warning,
       coalesce(n_recommendation, 0) AS n_recommendation, coalesce(n_numbers, 0) AS n_numbers, insights_sha256
FROM x LEFT JOIN a USING (doc_id)
"""

_JOB2 = with_views(
    f"""WITH stats AS (
  SELECT poi_name, verdict_score, total_insights FROM ({catalog.ORACLE_SQL["poi_stats"]}) p
), sight AS (
  SELECT poi_name, sub_attraction AS item, count(*) AS n, round(count(*) FILTER (insight_sentiment = 'positive') / count(*)::DOUBLE, 6) AS score
  FROM insights WHERE sub_attraction <> '' GROUP BY ALL HAVING count(*) >= 2
), good AS (
  SELECT poi_name, 'highlights' AS section, cluster_id, name, size, round(0.55 + {catalog._HYBRID}, 9) AS score FROM clusters WHERE quality_tier = 'A' AND sentiment = 'positive'
), bad AS (
  SELECT poi_name, 'concerns' AS section, cluster_id, name, size, size * least(n_sources / 5.0, 1.0) AS score FROM clusters
  WHERE (l1 = 'Operational Intelligence' OR secondary_l1 = 'Operational Intelligence') AND sentiment IN ('negative', 'mixed')
), chosen AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY poi_name, section ORDER BY score DESC, cluster_id) AS rank FROM (SELECT * FROM good UNION ALL SELECT * FROM bad) g) h WHERE rank <= 10
), quoted AS (
  SELECT cluster_id, string_agg(source || ':' || source_id || ':' || rating, '|' ORDER BY rank) AS quotes FROM ({catalog.ORACLE_SQL["evidence"]}) e GROUP BY cluster_id
)
SELECT poi_name, 'verdict' AS section, 1 AS rank, CASE WHEN verdict_score >= 85 THEN 'An unambiguous yes.' WHEN verdict_score >= 70 THEN 'Yes, but never on a Saturday.'
  WHEN verdict_score >= 55 THEN 'Worth it — barely.' ELSE 'Skip it, or plan very carefully.' END AS item, total_insights AS n, verdict_score::DOUBLE AS score, '' AS quotes FROM stats
UNION ALL SELECT poi_name, 'sights', rank, item, n, score, '' FROM (SELECT *, row_number() OVER (PARTITION BY poi_name ORDER BY n DESC, item) AS rank FROM sight) s WHERE rank <= 10
UNION ALL SELECT poi_name, section, rank, name, size, round(score, 6), coalesce(quotes, '') FROM chosen LEFT JOIN quoted USING (cluster_id)""",
    "clusters",
    "insights",
)

ORACLE_SQL: dict[str, str] = {"job1_intake": _JOB1, "job2_dossiers": _JOB2}
