"""The registered queries of the library, each operator over a whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner import models
from gleaner.functions import dates, scores, taxonomy, text
from gleaner.operators import chunks, cleaning, dedupe, joins, language, mentions, rollups, sampling, vectors
from gleaner.plans.bindings import tables, view, with_views
from gleaner.plans.engine import Engine, Store
from gleaner.sources import parsers, place_pages, readers
from gleaner.storage import Steps
from gleaner.streaming import ingest, progress

FLAGSHIP = "poi_stats"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = "2024-02-01 00:00:00"


def query(sql: str | None = None, *views: str):
    """Registers a function under its name, with its SQL over the binding views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


def _counts(col: str, buckets: list[str], prefix: str) -> str:
    return ", ".join(f"count(*) FILTER ({col} = '{b}') AS \"{prefix}_{b}\"" for b in buckets)


def _insights(spark, sf):
    return view(spark, sf, "insights").withColumn("numeric_anchors", F.array("anchor"))


def _clusters(spark, sf):
    c = F.col("cluster_id")
    lists = {"anchor_entities": F.array("anchor"), "centroid_text_indices": F.array(c * 3), "member_indices": F.array(c, c + 1, c + 5, c + 10, c + 7)}
    return view(spark, sf, "clusters").withColumns(lists)


def _zeros() -> str:
    names = [f"tier_{b}" for b in rollups.TIERS] + [f"sentiment_{b}" for b in rollups.SENTIMENTS] + [f"intent_{b}" for b in rollups.INTENTS]
    names += [f"l1_{b}" for b in taxonomy.VALID_L1] + [f"source_{b}" for b in rollups.SOURCES] + ["total_clusters", "total_insights"]
    return ", ".join(f'coalesce("{n}", 0) AS "{n}"' for n in names)


# ---- rollups ----


@query(
    f"""WITH c AS (SELECT poi_name, count(*) AS total_clusters, {_counts("quality_tier", rollups.TIERS, "tier")} FROM clusters GROUP BY poi_name),
i AS (SELECT poi_name, count(*) AS total_insights, {_counts("insight_sentiment", rollups.SENTIMENTS, "sentiment")}, {_counts("intent_tag", rollups.INTENTS, "intent")},
  {_counts("l1", taxonomy.VALID_L1, "l1")}, {_counts("source", rollups.SOURCES, "source")} FROM insights GROUP BY poi_name),
b AS (SELECT coalesce(c.poi_name, i.poi_name) AS poi_name, {_zeros()} FROM c FULL JOIN i ON c.poi_name = i.poi_name)
SELECT *, CAST(greatest(0, least(100, round_even(100 * (0.5 * CASE WHEN total_clusters > 0 THEN "tier_A"::DOUBLE / total_clusters ELSE 0 END
  + 0.3 * CASE WHEN total_insights > 0 THEN sentiment_positive::DOUBLE / total_insights ELSE 0 END
  + 0.2 * (1 - CASE WHEN total_insights > 0 THEN intent_warning::DOUBLE / total_insights ELSE 0 END)), 0))) AS INT) AS verdict_score FROM b""",
    "insights",
    "clusters",
)
def poi_stats(spark, sf):
    return rollups.poi_stats(_clusters(spark, sf), _insights(spark, sf))


@query(
    """WITH base AS (SELECT *, regexp_extract(anchor, '(\\d+)', 1)::DOUBLE * CASE WHEN anchor LIKE '%hours' THEN 60 ELSE 1 END AS m FROM insights WHERE sub_attraction <> ''),
s AS (SELECT poi_name, sub_attraction, count(*) AS n_insights, count(DISTINCT source) AS n_sources,
  count(*) FILTER (insight_sentiment = 'positive') AS positive_count, count(*) FILTER (insight_sentiment = 'negative') AS negative_count,
  count(*) FILTER (intent_tag = 'warning') AS warning_count, count(*) FILTER (intent_tag = 'recommendation') AS recommendation_count,
  median(m) AS avg_minutes FROM base GROUP BY ALL HAVING count(*) >= 2),
c AS (SELECT *, row_number() OVER (PARTITION BY poi_name, sub_attraction ORDER BY n DESC, f) AS r FROM (SELECT poi_name, sub_attraction, cluster_id, count(*) AS n, min(flat_idx) AS f FROM base GROUP BY ALL) x),
t AS (SELECT *, row_number() OVER (PARTITION BY poi_name, sub_attraction ORDER BY n DESC, f) AS r FROM (SELECT poi_name, sub_attraction, intent_tag, count(*) AS n, min(flat_idx) AS f FROM base GROUP BY ALL) x)
SELECT s.*, (SELECT string_agg(cluster_id::VARCHAR, ',' ORDER BY r) FROM c WHERE r <= 3 AND c.poi_name = s.poi_name AND c.sub_attraction = s.sub_attraction) AS top_clusters,
  (SELECT string_agg(intent_tag || '=' || n, ',' ORDER BY r) FROM t WHERE r <= 5 AND t.poi_name = s.poi_name AND t.sub_attraction = s.sub_attraction) AS top_intents FROM s""",
    "insights",
)
def sub_attractions(spark, sf):
    out = rollups.sub_attractions(_insights(spark, sf))
    pairs = F.transform(F.map_entries("top_intent_tags"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.select(*[c for c in out.columns if c not in ("sample_cluster_ids", "top_intent_tags")], F.array_join(F.col("sample_cluster_ids").cast("array<string>"), ",").alias("top_clusters"), F.array_join(pairs, ",").alias("top_intents"))


@query(
    """WITH n AS (SELECT label, source, count(*) AS n FROM (SELECT label, CASE vec_id % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' WHEN 3 THEN 'd' ELSE 'e' END AS source FROM embeddings) e GROUP BY ALL),
k AS (SELECT label, sum(n)::BIGINT AS size, concat('place', label % 4) AS poi_name FROM n GROUP BY ALL)
SELECT k.poi_name, count(*) AS n_clusters, sum(size)::BIGINT AS n_insights, count(*) FILTER (size >= 50) AS n_tier_a,
  (SELECT string_agg(DISTINCT source, ',' ORDER BY source) FROM n WHERE concat('place', n.label % 4) = k.poi_name) AS sources FROM k GROUP BY k.poi_name""",
)
def poi_summary(spark, sf):
    e = tables(spark, sf, "embeddings")["embeddings"]
    rows = e.select(F.col("label").alias("cluster_id"), F.element_at(F.array(*map(F.lit, "abcde")), (F.col("vec_id") % 5 + 1).cast("int")).alias("source"))
    c = rollups.source_mix(rows).withColumns({"poi_name": F.concat(F.lit("place"), (F.col("cluster_id") % 4).cast("string")), "quality_tier": F.when(F.col("size") >= 50, "A")})
    return rollups.poi_summary(c).withColumn("sources", F.array_join("sources", ","))


@query(
    "SELECT cluster_id, sum(n)::BIGINT AS size, string_agg(source || '=' || n, ',' ORDER BY source) AS source_mix, count(*) AS n_sources FROM (SELECT cluster_id, source, count(*) AS n FROM members GROUP BY ALL) x GROUP BY cluster_id",
    "members",
)
def source_mix(spark, sf):
    pairs = F.transform(F.map_entries("source_mix"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return rollups.source_mix(view(spark, sf, "members")).withColumn("source_mix", F.array_join(pairs, ","))


@query("SELECT n_sources, count(*) AS n_clusters FROM clusters GROUP BY n_sources", "clusters")
def diversity_profile(spark, sf):
    return rollups.diversity_profile(_clusters(spark, sf))


@query("SELECT poi_name, avg(CASE WHEN n_sources >= 2 THEN 1.0 ELSE 0.0 END) AS share FROM clusters GROUP BY poi_name", "clusters")
def corroborated_share(spark, sf):
    return rollups.corroborated_share(_clusters(spark, sf))


@query("SELECT (SELECT count(*) FROM clusters) AS n_clusters, (SELECT count(*) FROM insights) AS n_insights, (SELECT string_agg(DISTINCT poi_name, ',' ORDER BY poi_name) FROM clusters) AS pois", "clusters", "insights")
def health(spark, sf):
    return rollups.health(_clusters(spark, sf), _insights(spark, sf)).withColumn("pois", F.array_join("pois", ","))


@query(
    "SELECT f AS field, n AS n_filled, n / total AS ratio FROM (SELECT count(*) AS total, count(quality) AS quality, count(lang) AS lang, count(nullif(toxic, 0)) AS toxic FROM documents LEFT JOIN labels USING (doc_id)) x, LATERAL (VALUES ('quality', quality), ('lang', lang), ('toxic', toxic)) v(f, n)"
)
def completeness(spark, sf):
    t = tables(spark, sf, "documents", "labels")
    return rollups.completeness(t["documents"].join(t["labels"], "doc_id", "left").withColumn("toxic", F.nullif("toxic", F.lit(0))), ["quality", "lang", "toxic"])


_LITERAL = ["Error 404", "Page  not found here", "Skip to main content menu", "short", "   ", "[a](b)" * 60, "x" * 300]
_REASON = """CASE WHEN trim(text, ' ' || chr(9) || chr(10)) = '' THEN 'empty_text' WHEN regexp_matches(text, '(?i)error\\s*404|404\\s*not\\s*found|page\\s*not\\s*found') THEN 'error_404'
 WHEN starts_with(lower(ltrim(text)), 'skip to main content') AND length(text) < 300 THEN 'nav_cruft_short' WHEN length(text) < 250 THEN 'too_short_<250'
 WHEN list_sum(list_transform(regexp_extract_all(text, '\\[[^\\]]*\\]\\([^)]*\\)'), lambda x: length(x))) / length(text) > 0.5 THEN 'mostly_md_links' END"""


@query(f"""WITH rows AS (SELECT page_id % 3 AS poi, html AS text FROM pages UNION ALL SELECT 7, unnest([{", ".join(f"'{x}'" for x in _LITERAL)}]))
SELECT poi, reason, count(*) AS n FROM (SELECT poi, {_REASON} AS reason FROM rows) r WHERE reason IS NOT NULL GROUP BY ALL""")
def drop_reasons(spark, sf):
    pages = tables(spark, sf, "pages")["pages"].select((F.col("page_id") % 3).alias("poi"), F.col("html").alias("text"))
    rows = pages.unionByName(spark.createDataFrame([(7, x) for x in _LITERAL], "poi bigint, text string"))
    return rollups.drop_report(rows, cleaning.page_drop(F.col("text")), "poi")[0]


@query("SELECT lang, count(*) AS n_in, count(*) FILTER (length(text) >= 100 AND contains(lower(text), 'the')) AS n_out, round(100.0 * count(*) FILTER (length(text) >= 100 AND contains(lower(text), 'the')) / count(*), 1) AS kept_pct FROM documents GROUP BY lang")
def thread_cleaning(spark, sf):
    return rollups.drop_report(tables(spark, sf, "documents")["documents"], cleaning.thread_drop(F.lit("The"), F.col("text")), "lang")[1]


@query("SELECT l1, l2, count(*) AS n, round(avg(confidence), 6) AS avg_confidence, count(*) FILTER (confidence < 0.65) AS n_low FROM (SELECT l1, l2, flat_idx % 100 / 100.0 AS confidence FROM insights) x GROUP BY ROLLUP (l1, l2)", "insights")
def taxonomy_rollup(spark, sf):
    return rollups.label_profile(_insights(spark, sf).withColumn("confidence", F.col("flat_idx") % 100 / 100.0)).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_probe(spark, sf):
    return rollups.duplicate_keys(tables(spark, sf, "lineitem")["lineitem"], "l_orderkey", "l_linenumber")


@query("SELECT poi_name, l1, n, round(100.0 * n / sum(n) OVER (PARTITION BY poi_name), 1) AS pct FROM (SELECT poi_name, l1, count(*) AS n FROM clusters GROUP BY ALL) x", "clusters")
def label_shares(spark, sf):
    return rollups.shares(_clusters(spark, sf), "poi_name", "l1")


@query("SELECT user_id, list_sort(list(value))[count(*) // 2 + 1] AS depth, list_reverse_sort(list(value))[count(*) // 2 + 1] AS score, max(value) AS top, round(avg(value), 6) AS mean FROM events GROUP BY user_id")
def middle_pick(spark, sf):
    own = F.collect_list("value")
    return tables(spark, sf, "events")["events"].groupBy("user_id").agg(rollups.middle_pick(own).alias("depth"), rollups.middle_pick(own, True).alias("score"), F.max("value").alias("top"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT l_orderkey AS url, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS intents, count(*) AS n_paths, count(DISTINCT l_returnflag) > 1 AS multi FROM lineitem GROUP BY l_orderkey")
def provenance_fan_in(spark, sf):
    out = rollups.provenance(tables(spark, sf, "lineitem")["lineitem"].withColumnRenamed("l_orderkey", "url"), "url", "l_returnflag")
    return out.withColumn("intents", F.array_join("intents", ","))


@query("SELECT token AS tag, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS token FROM benchmark) x GROUP BY token ORDER BY n DESC, token LIMIT 30")
def top_tags(spark, sf):
    return rollups.tag_counts(tables(spark, sf, "benchmark")["benchmark"].withColumn("tags", F.split("text", " ", -1)), "tags", 30)


@query("SELECT n_name, count(*) AS n, round(avg(c_acctbal), 6) AS avg_balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def sql_report(spark, sf):
    t = tables(spark, sf, "customer", "nation")
    return spark.sql("SELECT n_name, count(*) AS n, round(avg(c_acctbal), 6) AS avg_balance FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name", **t)


# ---- dedupe, state ----


@query("SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY ALL")
def dedupe_first(spark, sf):
    return dedupe.first_wins(tables(spark, sf, "events")["events"].select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def dedupe_last(spark, sf):
    return dedupe.last_wins(tables(spark, sf, "events")["events"].select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@query(
    """WITH old AS (SELECT user_id, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS kind FROM events WHERE event_id % 2 = 0 GROUP BY user_id),
new AS (SELECT user_id, arg_max(value, event_id) AS value FROM events WHERE event_id % 2 = 1 AND user_id % 3 = 0 GROUP BY user_id)
SELECT coalesce(n.user_id, o.user_id) AS user_id, CASE WHEN n.user_id IS NOT NULL THEN n.value ELSE o.value END AS value, o.kind FROM old o FULL JOIN new n ON o.user_id = n.user_id"""
)
def upsert_merge(spark, sf):
    e = tables(spark, sf, "events")["events"]
    old = dedupe.last_wins(e.filter("event_id % 2 = 0"), ["user_id"], ["event_id"]).select("user_id", "value", F.col("event_type").alias("kind"))
    return dedupe.upsert(old, e.filter("event_id % 2 = 1 AND user_id % 3 = 0").select("user_id", "value", "event_id"), ["user_id"], "event_id")


@query(
    """WITH w AS (SELECT DISTINCT user_id AS poi_id, event_type AS sort_mode FROM events), c AS (SELECT user_id AS poi_id, event_type AS sort_mode, count(*)::INT * 10 AS next_offset FROM events WHERE user_id % 2 = 0 GROUP BY ALL)
SELECT poi_id, sort_mode, coalesce(next_offset, 0) AS next_offset, false AS exhausted FROM w LEFT JOIN c USING (poi_id, sort_mode)"""
)
def cursor_state(spark, sf):
    e = tables(spark, sf, "events")["events"].select(F.col("user_id").alias("poi_id"), F.col("event_type").alias("sort_mode"))
    stored = e.filter("poi_id % 2 = 0").groupBy("poi_id", "sort_mode").agg((F.count(F.lit(1)).cast("int") * 10).alias("next_offset")).withColumn("exhausted", F.lit(None).cast("boolean"))
    return dedupe.cursor_of(e.distinct(), stored, ["poi_id", "sort_mode"], {"next_offset": F.lit(0), "exhausted": F.lit(False)})


@query("SELECT item_id, via, mode FROM (SELECT DISTINCT l_orderkey AS item_id, l_suppkey AS via, l_returnflag AS mode FROM lineitem) x")
def insert_links(spark, sf):
    rows = tables(spark, sf, "lineitem")["lineitem"].select(F.col("l_orderkey").alias("item_id"), F.col("l_suppkey").alias("via"), F.col("l_returnflag").alias("mode"))
    old = rows.filter("item_id % 2 = 0").dropDuplicates()
    return dedupe.insert_new(old, rows, ["item_id", "via", "mode"])


@query("SELECT o_custkey AS natural_key, sha256(o_custkey::VARCHAR) AS id FROM orders GROUP BY o_custkey")
def upsert_ids(spark, sf):
    rows = tables(spark, sf, "orders")["orders"].select(F.col("o_custkey").alias("natural_key"), F.col("o_orderkey").alias("seq"))
    empty = spark.createDataFrame([], "natural_key bigint, id string")
    return dedupe.upsert_returning(empty, rows, "natural_key", "seq")[1]


@query("SELECT 'kept' AS side, count(*) AS n FROM lineitem WHERE l_orderkey % 7 <> 0 UNION ALL SELECT 'parents', count(*) FROM orders WHERE o_orderkey % 7 <> 0")
def delete_cascade(spark, sf):
    t = tables(spark, sf, "orders", "lineitem")
    p, c = dedupe.delete_cascade(t["orders"], t["lineitem"], t["orders"].filter("o_orderkey % 7 = 0"), "o_orderkey", "l_orderkey")
    return c.agg(F.count(F.lit(1)).alias("n")).select(F.lit("kept").alias("side"), "n").unionByName(p.agg(F.count(F.lit(1)).alias("n")).select(F.lit("parents").alias("side"), "n"))


@query("SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN concat(s_name, '*') ELSE s_name END AS s_name, CASE WHEN s_nationkey = 3 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def update_where(spark, sf):
    s = tables(spark, sf, "supplier")["supplier"].select("s_suppkey", "s_name", "s_acctbal", "s_nationkey")
    return dedupe.update_where(s, F.col("s_nationkey") == 3, {"s_name": F.concat("s_name", F.lit("*")), "s_acctbal": F.lit(0.0)}).drop("s_nationkey")


@query(
    """SELECT violations, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN NOT l_quantity BETWEEN 1 AND 40 THEN 'quantity' END, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'flag' END,
 CASE WHEN row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) > 1 THEN 'unique' END) AS violations FROM lineitem) x GROUP BY violations"""
)
def constraint_violations(spark, sf):
    rules = {"quantity": F.col("l_quantity").between(1, 40), "flag": F.col("l_returnflag").isin("A", "N")}
    order = ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity"]
    good, bad = dedupe.validate(tables(spark, sf, "lineitem")["lineitem"], rules, ["l_orderkey", "l_linenumber"], order)
    both = good.select(F.lit("").alias("violations")).unionByName(bad.select(F.array_join("violations", ",").alias("violations")))
    return rollups.distribution(both, "violations")


# ---- top-k, samples ----

_QUOTAS = [(1, 200), (2, 100), (3, 50), (4, 50), (5, 100)]


@query("SELECT source, rating, flat_idx FROM (SELECT *, row_number() OVER (PARTITION BY source, rating ORDER BY freshness_score DESC NULLS FIRST, flat_idx) AS rn FROM insights) x WHERE rn <= CASE rating WHEN 1 THEN 200 WHEN 2 THEN 100 WHEN 5 THEN 100 ELSE 50 END", "insights")
def strat_quota(spark, sf):
    return sampling.quota(_insights(spark, sf), ["source"], spark.createDataFrame(_QUOTAS, "rating int, n int"), "rating", "freshness_score", "flat_idx").select("source", "rating", "flat_idx")


@query("SELECT band, rating, flat_idx FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY flat_idx) AS rn FROM (SELECT flat_idx, rating, CASE rating WHEN 5 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 2 END AS band FROM insights) y) x WHERE rn <= 120", "insights")
def band_sample(spark, sf):
    return sampling.bands(_insights(spark, sf), "rating", [[5], [1], [3, 4], [2]], 120, "flat_idx").select("band", "rating", "flat_idx")


@query("SELECT flat_idx, poi_name, turn FROM (SELECT *, row_number() OVER (PARTITION BY poi_name ORDER BY flat_idx) AS turn, min(flat_idx) OVER (PARTITION BY poi_name) AS seen FROM insights) x ORDER BY turn, seen LIMIT 61", "insights")
def round_robin(spark, sf):
    return sampling.round_robin(_insights(spark, sf).select("flat_idx", "poi_name"), "poi_name", "flat_idx", 61)


@query("SELECT doc_id, n_chars FROM (SELECT * FROM documents ORDER BY n_chars DESC NULLS FIRST, doc_id LIMIT 300) x WHERE lang = 'fr' ORDER BY n_chars DESC NULLS FIRST, doc_id LIMIT 100")
def overfetch_topk(spark, sf):
    return sampling.overfetch(tables(spark, sf, "documents")["documents"], "n_chars", "doc_id", F.col("lang") == "fr", 100, 3).select("doc_id", "n_chars")


@query("SELECT poi_name, intent_tag, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY poi_name ORDER BY n DESC, f) AS rank FROM (SELECT poi_name, intent_tag, count(*) AS n, min(flat_idx) AS f FROM insights GROUP BY ALL) y) x WHERE rank <= 5", "insights")
def topk_per_group(spark, sf):
    return sampling.most_common(_insights(spark, sf), ["poi_name"], "intent_tag", "flat_idx", 5)


@query("SELECT conv_id, count(*) AS n, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS picked FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations) x WHERE c >= 3 AND i IN (0, c // 2, c - 1) GROUP BY conv_id")
def first_middle_last(spark, sf):
    c = tables(spark, sf, "conversations")["conversations"].groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    c = c.withColumn("p", sampling.first_middle_last(F.col("t"))).filter("size(p) > 0")
    return c.select("conv_id", F.size("p").cast("bigint").alias("n"), F.array_join(F.col("p").cast("array<string>"), ",").alias("picked"))


@query("SELECT l1, cluster_id, section, rank FROM (SELECT *, row_number() OVER (PARTITION BY l1 ORDER BY size DESC, cluster_id) AS rank FROM (SELECT *, count(*) OVER (PARTITION BY l1) AS c, CASE l1 WHEN 'Visit Intelligence' THEN 1 WHEN 'Attention Intelligence' THEN 2 ELSE 3 END AS section FROM clusters) y WHERE c > 20 AND quality_tier = 'A') x WHERE rank <= 6", "clusters")
def card_sections(spark, sf):
    order = {k: min(i + 1, 3) for i, k in enumerate(taxonomy.VALID_L1)}
    return sampling.sections(_clusters(spark, sf), order).select("l1", "cluster_id", "section", "rank")


@query("SELECT poi_name, max_by(cluster_id, (size, -cluster_id)) AS cluster_id FROM clusters GROUP BY poi_name", "clusters")
def largest_cluster(spark, sf):
    out = sampling.argmax(_clusters(spark, sf), ["poi_name"], F.col("cluster_id"), F.struct("size", -F.col("cluster_id")))
    return out.withColumnRenamed("best", "cluster_id")


@query("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS batch FROM conversations")
def batch_numbers(spark, sf):
    return sampling.batches(tables(spark, sf, "conversations")["conversations"], "turn", 3, ["conv_id"]).select("conv_id", "turn", "batch")


# ---- filters, joins, sets ----

_FILTER = {"rating_min": 3, "source": ["google_review", "reddit_post"], "insight_sentiment": ["positive", "mixed"], "has_numeric": True, "sub_attraction": "C", "min_freshness": 0.2, "unknown": 1}


@query("SELECT flat_idx FROM insights WHERE rating >= 3 AND source IN ('google_review', 'reddit_post') AND insight_sentiment IN ('positive', 'mixed') AND contains(lower(sub_attraction), 'c') AND freshness_score >= 0.2", "insights")
def insight_filter(spark, sf):
    return _insights(spark, sf).filter(cleaning.insight_filter(_FILTER)).select("flat_idx")


@query("SELECT video_id FROM videos WHERE views >= CASE format WHEN 'short' THEN 5000 ELSE 10000 END AND duration_seconds >= 30", "videos")
def engaging_videos(spark, sf):
    return view(spark, sf, "videos").filter(cleaning.engaging(F.col("views"), F.col("duration_seconds"), F.col("format"))).select("video_id")


@query("SELECT poi_name, l1, cluster_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY poi_name, l1 ORDER BY size DESC, cluster_id) AS rank FROM (SELECT *, max(CASE WHEN sentiment = 'negative' THEN 1 ELSE 0 END) OVER (PARTITION BY poi_name, l1) AS f FROM clusters) y WHERE f = 0 OR sentiment = 'negative') x WHERE rank <= 3", "clusters")
def preferred_or_all(spark, sf):
    out = cleaning.preferred_or_all(_clusters(spark, sf), F.col("sentiment") == "negative", ["poi_name", "l1"], 3, [F.desc("size"), F.asc("cluster_id")])
    return out.select("poi_name", "l1", "cluster_id", "rank")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def anti_missing(spark, sf):
    t = tables(spark, sf, "orders", "lineitem")
    return joins.missing(t["orders"].select("o_orderkey"), t["lineitem"].withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")


@query("SELECT c.conv_id, c.turn, p.role AS post_role FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = 0 AND p.role = 'user' WHERE c.turn > 0")
def orphan_drop(spark, sf):
    c = tables(spark, sf, "conversations")["conversations"]
    return joins.with_parent(c.filter("turn > 0").select("conv_id", "turn"), c.filter("turn = 0 AND role = 'user'").select("conv_id", F.col("role").alias("post_role")), "conv_id")


@query(
    """WITH f AS (SELECT DISTINCT l_orderkey % (SELECT max(conv_id) + 1 FROM conversations) AS post_id, l_returnflag AS intent, l_linestatus AS via FROM lineitem), c AS (SELECT conv_id * 100 + turn AS id, conv_id AS post_id FROM conversations WHERE turn > 0)
SELECT post_id AS item_id, 'post' AS item_type, intent, via FROM f WHERE post_id IN (SELECT conv_id FROM conversations) UNION ALL SELECT c.id, 'comment', intent, via FROM f JOIN c USING (post_id)"""
)
def link_explosion(spark, sf):
    """Every line of an order finds a post; post ids are over the whole range of conversations."""
    t = tables(spark, sf, "lineitem", "conversations")
    c = t["conversations"]
    n = c.agg(F.max("conv_id") + 1).head()[0]
    found = t["lineitem"].select((F.col("l_orderkey") % F.lit(n)).alias("post_id"), F.col("l_returnflag").alias("intent"), F.col("l_linestatus").alias("via")).distinct()
    return joins.link_explosion(found, c.select(F.col("conv_id").alias("id")).distinct(), c.filter("turn > 0").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("conv_id").alias("post_id")))


@query("SELECT m AS flat_idx, min(cluster_id) AS cluster_id, arg_min(name, cluster_id) AS name FROM (SELECT cluster_id, name, unnest([cluster_id, cluster_id // 2, cluster_id % 10]) AS m FROM clusters) x GROUP BY m", "clusters")
def first_cluster(spark, sf):
    c = _clusters(spark, sf).withColumn("member_indices", F.array("cluster_id", F.expr("cluster_id div 2"), F.col("cluster_id") % 10))
    return joins.cluster_of_members(c, ["name"])


@query("SELECT c.conv_id, c.turn FROM conversations c WHERE c.turn > 0 AND (EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = 0 AND p.role = 'system') OR contains(lower(c.text), 'ende') OR contains(lower(c.text), 'tion'))")
def existence_or(spark, sf):
    c = tables(spark, sf, "conversations")["conversations"]
    kept = c.filter("turn = 0 AND role = 'system'").select("conv_id", F.lit(True).alias("kept")).distinct()
    own = c.filter("turn > 0").join(kept, "conv_id", "left")
    return own.filter(cleaning.accepted_comment(F.col("kept"), F.col("text"), ["ende", "tion"])).select("conv_id", "turn")


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'second' WHEN b.k IS NULL THEN 'first' ELSE 'both' END AS found_in FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 3 = 0) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 5 = 0) b ON a.k = b.k")
def overlap_sets(spark, sf):
    o = tables(spark, sf, "orders")["orders"].withColumnRenamed("o_custkey", "k")
    return joins.overlap(o.filter("o_orderkey % 3 = 0"), o.filter("o_orderkey % 5 = 0"), "k")


@query("SELECT count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) x UNION ALL SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) y UNION ALL SELECT count(*) FROM (SELECT n_name FROM nation UNION ALL SELECT r_name FROM region) z")
def set_operations(spark, sf):
    t = tables(spark, sf, "customer", "supplier", "orders", "nation", "region")
    n = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    both = t["customer"].select("c_nationkey").intersect(t["supplier"].select("s_nationkey"))
    less = t["customer"].select("c_custkey").subtract(t["orders"].select("o_custkey"))
    return n(both).unionByName(n(less)).unionByName(n(t["nation"].select("n_name").unionAll(t["region"].select("r_name"))))


@query(
    "SELECT name, intent_category, min(replace(template, '{poi}', poi)) AS query_term FROM (SELECT n_name AS name, unnest(CASE WHEN use THEN [n_name, concat('the ', n_name)] ELSE [n_name] END) AS poi, intent_category, template FROM nation, (VALUES "
    + ", ".join(f"('{i}', '{q}', {str(a).lower()})" for i, q, a in joins.TEMPLATES)
    + ") t(intent_category, template, use)) x GROUP BY name, intent_category, replace(template, '{poi}', poi)"
)
def templates(spark, sf):
    pois = tables(spark, sf, "nation")["nation"].select(F.col("n_name").alias("name"), F.array(F.concat(F.lit("the "), "n_name")).alias("aliases"))
    return joins.search_queries(spark, pois)


@query("SELECT flat_idx, i.source, i.source_id, r.rating AS raw_rating FROM insights i LEFT JOIN raw r ON r.source = i.source AND r.source_id = i.source_id", "insights", "raw")
def raw_lookup(spark, sf):
    return joins.raw_lookup(_insights(spark, sf).select("flat_idx", "source", "source_id"), view(spark, sf, "raw"), "raw_order", ["rating"]).select("flat_idx", "source", "source_id", "raw_rating")


@query("SELECT flat_idx, coalesce(nullif(CASE WHEN flat_idx % 2 = 0 THEN 'given' ELSE '' END, ''), r.source_url) AS source_url FROM insights i LEFT JOIN raw r ON r.source = i.source AND r.source_id = i.source_id", "insights", "raw")
def fill_urls(spark, sf):
    rows = _insights(spark, sf).select("flat_idx", "source", "source_id", F.when(F.col("flat_idx") % 2 == 0, "given").otherwise("").alias("source_url"))
    return joins.fill_urls(rows, view(spark, sf, "raw")).select("flat_idx", "source_url")


@query("SELECT c_custkey, n_name AS poi_name, concat('region', n_regionkey) AS city FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def with_place(spark, sf):
    t = tables(spark, sf, "customer", "nation")
    pois = t["nation"].select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("city"))
    return joins.with_place(t["customer"].select("c_custkey", F.col("c_nationkey").alias("poi_id")), pois).drop("poi_id")


@query("SELECT DISTINCT x.cluster_id AS a, y.cluster_id AS b FROM clusters x JOIN clusters y ON x.poi_name = y.poi_name AND x.anchor = y.anchor AND x.cluster_id < y.cluster_id WHERE abs(x.size - y.size) < 3", "clusters")
def anchor_pairs(spark, sf):
    c = _clusters(spark, sf).select("cluster_id", "poi_name", "size", F.col("anchor_entities").alias("anchors"))
    return joins.anchor_pairs(c, F.abs(F.col("x.size") - F.col("y.size")), 3)


# ---- scalar functions ----


@query("SELECT video_id, round_even(0.5 * least(views / 500000.0, 1.0) + 0.3 * least(likes / greatest(views, 1)::DOUBLE / 0.05, 1.0) + 0.2 * least(comment_count / greatest(views, 1)::DOUBLE / 0.01, 1.0), 4) AS score FROM videos", "videos")
def video_score(spark, sf):
    return view(spark, sf, "videos").select("video_id", scores.video_score(F.col("views"), F.col("likes"), F.col("comment_count")).alias("score"))


@query("SELECT cluster_id, CASE WHEN (greatest(n_sources, l) >= 4 AND size >= 3) OR size >= 15 THEN 'A' WHEN greatest(n_sources, l) >= 3 OR size >= 8 THEN 'B' ELSE 'C' END AS tier FROM (SELECT *, label % 5 + 1 AS l FROM clusters) x", "clusters")
def tier(spark, sf):
    return _clusters(spark, sf).select("cluster_id", scores.quality_tier(F.col("n_sources"), F.col("label") % 5 + 1, F.col("size")).alias("tier"))


@query(f"SELECT event_id, round(CASE WHEN event_id % 10 = 0 THEN 0.5 WHEN ts >= TIMESTAMP '{AS_OF}' THEN 1.0 ELSE exp(-(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(date_trunc('second', ts))) / 1e6 / (2 * 365.25 * 24 * 3600)) END, 9) AS freshness FROM events")
def freshness(spark, sf):
    e = tables(spark, sf, "events")["events"]
    created = F.when(F.col("event_id") % 10 == 0, "unknown").otherwise(F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss"))
    return e.select("event_id", F.round(scores.freshness(created, AS_OF), 9).alias("freshness"))


@query("SELECT flat_idx, regexp_extract(anchor, '(\\d+)', 1)::DOUBLE * CASE WHEN anchor LIKE '%hours' THEN 60 ELSE 1 END AS minutes FROM insights", "insights")
def minutes(spark, sf):
    return _insights(spark, sf).select("flat_idx", text.minutes(F.col("anchor")).alias("minutes"))


@query("SELECT doc_id, concat('syn_', left(sha256(concat_ws('|', lower(source), left(lower(regexp_replace(trim(text, ' ' || chr(10)), '\\s+', ' ', 'g')), 200), lang, '')), 16)) AS id FROM documents")
def synthetic_id(spark, sf):
    return tables(spark, sf, "documents")["documents"].select("doc_id", text.synthetic_review_id(F.col("source"), F.col("text"), F.col("lang"), F.lit(None).cast("string")).alias("id"))


@query("SELECT doc_id, concat('doc_', left(sha1(concat_ws('|', doc_id::VARCHAR, lang)), 12)) AS id FROM documents")
def stable_id(spark, sf):
    return tables(spark, sf, "documents")["documents"].select("doc_id", text.stable_id("doc", F.col("doc_id").cast("string"), F.col("lang")).alias("id"))


@query(
    """WITH d AS (SELECT doc_id, trim(text, ' ' || chr(10)) AS t FROM documents), h AS (SELECT doc_id, t, CASE WHEN contains(left(t, 400), ' ') THEN 400 - strpos(reverse(left(t, 400)), ' ') ELSE -1 END AS s FROM d)
SELECT doc_id, CASE WHEN length(t) <= 400 THEN t ELSE rtrim(left(t, CASE WHEN s < 240 THEN 400 ELSE s END), ' ' || chr(10)) || '…' END AS quote FROM h"""
)
def trim_quote(spark, sf):
    return tables(spark, sf, "documents")["documents"].select("doc_id", text.trim_quote(F.col("text")).alias("quote"))


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(left(text, 120))")
def near_dup(spark, sf):
    return dedupe.first_wins(tables(spark, sf, "documents")["documents"], [F.lower(F.substring("text", 1, 120))], ["doc_id"]).select("doc_id")


@query("SELECT page_id, lower(rtrim(string_split(url, '?')[1], '/')) AS url, CASE WHEN page_id = 0 THEN 'https://t.example/A-Reviews-B' ELSE concat('https://t.example/A-Reviews-or', page_id * 10, '-B') END AS paged FROM pages")
def url_functions(spark, sf):
    p = tables(spark, sf, "pages")["pages"]
    return p.select("page_id", text.plain_url(F.col("url")).alias("url"), text.page_url(F.lit("https://t.example/A-Reviews-B"), F.col("page_id") * 10).alias("paged"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-01') END AS month FROM events")
def visit_month(spark, sf):
    e = tables(spark, sf, "events")["events"]
    return e.select("event_id", dates.visit_month(F.when(F.col("event_id") % 4 == 0, "sometime").otherwise(F.date_format("ts", "MMMM yyyy"))).alias("month"))


@query("SELECT source, count(*) AS n, count(*) FILTER (length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) >= 75) AS n_long FROM raw GROUP BY source", "raw")
def length_filter(spark, sf):
    return view(spark, sf, "raw").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(cleaning.long_enough(F.col("text"), 75)).alias("n_long"))


@query("SELECT cluster_id, l1, CASE WHEN l1 <> 'Operational Intelligence' AND l1 <> 'Attention Intelligence' THEN l2 WHEN l1 = 'Operational Intelligence' THEN 'Pricing' ELSE 'Iconic Artwork' END AS l2, CASE WHEN l1 = 'Operational Intelligence' THEN 'Entrance Fee' WHEN l1 = 'Attention Intelligence' THEN 'Painting' ELSE l3 END AS l3, false AS label_valid FROM clusters", "clusters")
def label_recovery(spark, sf):
    return taxonomy.recover(_clusters(spark, sf).select("cluster_id", "l1", "l2", "l3"), taxonomy.combos(spark)).drop("label_recovered")


# ---- chunks ----


@query(
    """WITH RECURSIVE s AS (SELECT user_id, event_id, epoch_us(ts) // 1000 - min(epoch_us(ts) // 1000) OVER (PARTITION BY user_id) AS start_ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, i, start_ms, start_ms AS cs, 0 AS chunk FROM s WHERE i = 1 UNION ALL SELECT s.user_id, s.i, s.start_ms, CASE WHEN s.start_ms - r.cs >= 75000000 THEN s.start_ms ELSE r.cs END, CASE WHEN s.start_ms - r.cs >= 75000000 THEN r.chunk + 1 ELSE r.chunk END FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1)
SELECT user_id, chunk, min(start_ms) AS start_ms, max(start_ms) + 500 AS end_ms, string_agg('e' || event_id, ' ' ORDER BY r.i) AS text FROM r JOIN s USING (user_id, i, start_ms) GROUP BY user_id, chunk"""
)
def time_chunks(spark, sf):
    e = tables(spark, sf, "events")["events"]
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    e = e.select("user_id", "event_id", (ms - F.min(ms).over(Window.partitionBy("user_id"))).alias("start_ms"))
    seg = F.struct("start_ms", "event_id", F.lit(500).alias("duration_ms"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("text"))
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list(seg)).alias("s"))
    out = rows.select("user_id", F.posexplode(chunks.time_chunks(F.col("s"), 75_000_000)).alias("chunk", "c"))
    return out.select("user_id", "chunk", "c.start_ms", "c.end_ms", "c.text")


@query()
def sentence_chunks(spark, sf):
    d = tables(spark, sf, "documents")["documents"].select(F.col("doc_id").cast("string").alias("source_id"), "text", F.create_map().cast("map<string,string>").alias("meta"))
    return chunks.chunk_rows(d).select("source_id", "text")


@query()
def paragraph_chunks(spark, sf):
    return chunks.paragraph_chunks(tables(spark, sf, "documents")["documents"], "text", ["doc_id"])


# ---- parsers, models ----


@query("SELECT source_id, text, strength FROM (SELECT conv_id::VARCHAR AS source_id, text, CASE WHEN turn % 2 = 0 THEN 0.5 ELSE turn / 10.0 END AS strength FROM conversations) x")
def flatten_insights(spark, sf):
    c = tables(spark, sf, "conversations")["conversations"]
    item = F.struct(F.col("text"), F.when(F.col("turn") % 2 == 0, None).otherwise(F.col("turn") / 10.0).alias("strength"), F.lit(None).cast("string").alias("anchor_entity"))
    rows = c.groupBy(F.col("conv_id").cast("string").alias("source_id")).agg(F.collect_list(item).alias("insights"))
    rows = rows.withColumns({"source": F.lit(None).cast("string"), "poi_id": F.lit("p"), "poi_name": F.lit("p"), "rating": F.lit(None).cast("int")})
    return parsers.flatten_insights(rows, "thread").select("source_id", "text", "strength")


@query("SELECT conv_id * 100 + turn AS reddit_id, trim(text, ' ' || chr(10)) AS body, (conv_id % 50)::BIGINT AS post_score FROM conversations WHERE turn > 0 AND length(trim(text, ' ' || chr(10))) >= 20")
def thread_comments(spark, sf):
    c = tables(spark, sf, "conversations")["conversations"]
    blank = {k: F.lit(None).cast(t) for k, t in {"title": "string", "communityName": "string", "postUrl": "string", "upvoteRatio": "double", "commentsCount": "int", "engagementTotal": "int", "scorePerHour": "double", "isHighEngagement": "boolean", "wordCount": "int", "subredditSubscribers": "int", "createdAt": "string", "depth": "int", "parentId": "string", "parentKind": "string", "authorName": "string", "subredditName": "string", "commentCreatedAt": "string", "controversiality": "int", "ageHours": "double", "isSubmitter": "boolean", "url": "string", "parsedId": "string", "parsedPostId": "string"}.items()}
    posts = c.select("conv_id").distinct().select(F.lit("post").alias("dataType"), F.concat(F.lit("t3_"), F.col("conv_id").cast("string")).alias("id"), F.lit(None).cast("string").alias("postId"), F.lit(None).cast("string").alias("body"), (F.col("conv_id") % 50).alias("score"))
    replies = c.filter("turn > 0").select(F.lit("comment").alias("dataType"), (F.col("conv_id") * 100 + F.col("turn")).cast("string").alias("id"), F.concat(F.lit("t3_"), F.col("conv_id").cast("string")).alias("postId"), F.col("text").alias("body"), F.lit(1).cast("bigint").alias("score"))
    return parsers.thread_items(posts.unionByName(replies).withColumns(blank))[1].select(F.col("reddit_id").cast("bigint").alias("reddit_id"), "body", "post_score")


@query()
def embedded_documents(spark, sf):
    d = tables(spark, sf, "documents")["documents"]
    return d.select("doc_id", models.embed_column(models.HashingEmbedder())("text").alias("embedding"))


@query()
def extracted_insights(spark, sf):
    return models.extract_insights(view(spark, sf, "raw"), models.first_sentences)


@query("SELECT cluster_id, greatest(n_sources, 3) AS specificity, CASE WHEN cluster_id % 10 = 0 THEN 'C' WHEN (greatest(n_sources, 3) >= 4 AND size >= 3) OR size >= 15 THEN 'A' ELSE 'B' END AS quality_tier FROM clusters", "clusters")
def score_clusters(spark, sf):
    c = _clusters(spark, sf).drop("quality_tier")
    return models.score_clusters(c, F.col("n_sources"), F.lit(0), F.col("cluster_id") % 10 == 0).select("cluster_id", "specificity", "quality_tier")


# ---- vectors, retrieval ----


def _probe(spark, sf) -> list[float]:
    """The first vector as the query's."""
    return [float(x) for x in tables(spark, sf, "embeddings")["embeddings"].orderBy("vec_id").select("embedding").first()[0]]


_COS = "round(list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / ((sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-9) * (sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[])) + 1e-9)), 9)"
_TIER_W = "CASE quality_tier WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.6 ELSE 0.3 END"
_PROBE = "(SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1) p"
_HYBRID = f"0.25 * {_TIER_W} + 0.15 * least(n_sources / 5.0, 1.0) + 0.05 / (1 + exp((20.0 - size) / 10.0))"


def warm_engine(spark, sf) -> Engine:
    """The engine over a store in memory."""
    e = _engine(spark, sf)
    e.store.warm()
    for df in (e.store.clusters, e.store.insights, e.store.raw):
        df.count()
    return e


def _engine(spark, sf) -> Engine:
    insights = _insights(spark, sf).withColumn("anchor_entity", F.col("anchor")).join(tables(spark, sf, "embeddings")["embeddings"].select(F.col("vec_id").alias("flat_idx"), "embedding"), "flat_idx")
    return Engine(Store(_clusters(spark, sf), insights, view(spark, sf, "raw")))


@query(
    f"""WITH n AS (SELECT *, {_COS} AS cosine FROM clusters, {_PROBE} WHERE poi_name = 'place1' AND quality_tier IN ('A', 'B') ORDER BY cosine DESC, cluster_id LIMIT 50)
SELECT cluster_id, round(round(0.55 * cosine + {_HYBRID} + CASE WHEN anchor = 'anchor3' THEN 0.1 ELSE 0 END - CASE WHEN sentiment IN ('negative', 'mixed') THEN 0.04 ELSE 0 END, 9), 6) AS score FROM n""",
    "clusters",
)
def search_clusters(spark, sf):
    return _engine(spark, sf).ranked_clusters("place1", "the best of anchor3", _probe(spark, sf)).select("cluster_id", F.round("score", 6).alias("score"))


@query()
def search_mmr(spark, sf):
    return _engine(spark, sf).search_clusters("place1", "the best of anchor3", _probe(spark, sf)).drop("anchor_entities")


@query(
    f"""WITH n AS (SELECT i.*, {_COS} AS cosine FROM (SELECT i.*, e.embedding FROM insights i JOIN embeddings e ON e.vec_id = i.flat_idx) i, {_PROBE} WHERE poi_name = 'place2' AND rating >= 3 ORDER BY cosine DESC, flat_idx LIMIT 50)
SELECT n.flat_idx, c.name AS cluster_name, round(round(cosine + 0.10 * {_TIER_W} + 0.05 * freshness_score, 9), 6) AS score FROM n LEFT JOIN clusters c USING (cluster_id) ORDER BY round(cosine + 0.10 * {_TIER_W} + 0.05 * freshness_score, 9) DESC, flat_idx LIMIT 10""",
    "clusters",
    "insights",
)
def search_insights(spark, sf):
    return _engine(spark, sf).search_insights("place2", _probe(spark, sf), {"rating_min": 3}).select("flat_idx", "cluster_name", F.round("score", 6).alias("score"))


@query(
    f"""WITH n AS (SELECT i.*, {_COS} AS cosine FROM (SELECT i.*, e.embedding FROM insights i JOIN embeddings e ON e.vec_id = i.flat_idx) i, {_PROBE} WHERE poi_name = 'place2' AND rating >= 3 ORDER BY cosine DESC, flat_idx LIMIT 50)
SELECT n.flat_idx, n.l1, n.l2, coalesce(c.l3, '') AS l3, n.insight_sentiment, n.cluster_id, c.name AS cluster_name, round_even(round(cosine + 0.10 * {_TIER_W} + 0.05 * freshness_score, 9), 4) AS relevance_score
FROM n LEFT JOIN clusters c USING (cluster_id) ORDER BY round(cosine + 0.10 * {_TIER_W} + 0.05 * freshness_score, 9) DESC, flat_idx LIMIT 10""",
    "clusters",
    "insights",
)
def insight_cards(spark, sf):
    cards = _engine(spark, sf).insight_cards("place2", _probe(spark, sf), {"rating_min": 3})
    return cards.select("flat_idx", "l1", "l2", "l3", "insight_sentiment", "cluster_id", "cluster_name", "relevance_score")


@query(f"SELECT cluster_id, name FROM clusters WHERE poi_name = 'place1' AND quality_tier = 'A' AND sentiment = 'positive' ORDER BY round(0.55 + {_HYBRID}, 9) DESC, cluster_id LIMIT 10", "clusters")
def highlights(spark, sf):
    return _engine(spark, sf).list_highlights("place1").select("cluster_id", "name")


@query("SELECT cluster_id, name FROM clusters WHERE poi_name = 'place1' AND (l1 = 'Operational Intelligence' OR secondary_l1 = 'Operational Intelligence') AND sentiment IN ('negative', 'mixed') ORDER BY size * least(n_sources / 5.0, 1.0) DESC, cluster_id LIMIT 10", "clusters")
def concerns(spark, sf):
    return _engine(spark, sf).list_concerns("place1").select("cluster_id", "name")


@query(
    """WITH m AS (SELECT cluster_id, unnest([cluster_id * 3, cluster_id, cluster_id + 1, cluster_id + 5, cluster_id + 10, cluster_id + 7]) AS flat_idx, unnest([0, 1, 2, 3, 4, 5]) AS pos FROM clusters),
u AS (SELECT cluster_id, flat_idx, min(pos) AS pos FROM m GROUP BY ALL), j AS (SELECT u.cluster_id, pos, flat_idx, i.source, i.source_id, r.rating FROM u JOIN insights i USING (flat_idx) JOIN raw r ON r.source = i.source AND r.source_id = i.source_id WHERE r.text <> ''),
k AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, source ORDER BY pos) > 1 AS again FROM j), o AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY again, pos) AS rank FROM k)
SELECT cluster_id, rank, source, source_id, rating FROM o WHERE rank <= 3""",
    "clusters",
    "insights",
    "raw",
)
def evidence(spark, sf):
    insights = _insights(spark, sf).withColumn("anchor_entity", F.col("anchor"))
    return joins.evidence(_clusters(spark, sf), insights, view(spark, sf, "raw"), 3).select("cluster_id", "rank", "source", "source_id", "rating")


@query(
    """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY ALL),
n AS (SELECT label, sqrt(sum(m * m)) + 1e-9 AS l FROM c GROUP BY label), s AS (SELECT x.vec_id, x.label, round(sum(x.v * c.m) / any_value(n.l) / (sqrt(sum(x.v * x.v)) + 1e-9), 9) AS similarity FROM x JOIN c USING (label, i) JOIN n USING (label) GROUP BY ALL)
SELECT label, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS rank FROM s) r WHERE rank <= 5"""
)
def centroid_topk(spark, sf):
    return vectors.nearest_centroid(tables(spark, sf, "embeddings")["embeddings"], ["label"], "embedding", "vec_id").select("label", "vec_id", "rank")


@query()
def agglomerative(spark, sf):
    e = tables(spark, sf, "embeddings")["embeddings"].select(F.concat(F.lit("place"), (F.col("label") % 4).cast("string")).alias("poi_name"), F.col("vec_id").alias("flat_idx"), "embedding", F.concat(F.lit("anchor"), (F.col("label") % 3).cast("string")).alias("anchor_entity"))
    return vectors.number_clusters(vectors.cluster_places(e), e).select("poi_name", "cluster_id", "size")


@query()
def golden_eval(spark, sf):
    v = _probe(spark, sf)
    golden = [{"poi": f"place{k}", "query": "best", "vector": v, "expected_l1": taxonomy.VALID_L1[k], "must_mention": ["cluster"]} for k in range(3)]
    return rollups.accuracy(_engine(spark, sf).evaluate(golden))


@query(
    """WITH d AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents), w AS (SELECT doc_id, string_split(t, ' ') AS w FROM d),
p AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS name FROM w WHERE len(w) > 1), n AS (SELECT DISTINCT w[1] || ' ' || w[2] AS name FROM w WHERE len(w) > 1)
SELECT doc_id, name, count(*) AS n FROM p JOIN n USING (name) GROUP BY ALL"""
)
def name_mentions(spark, sf):
    """The first two words of every document are names, looked for in all documents."""
    plain = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    d = tables(spark, sf, "documents")["documents"].select("doc_id", plain.alias("plain"))
    names = d.filter(F.col("plain").contains(" ")).select(F.substring_index("plain", " ", 2).alias("name"))
    return mentions.count_mentions(d, "doc_id", "plain", names)


@query()
def detected_language(spark, sf):
    """Every document's language as detected, by profiles of four fifths of those whose language is known."""
    d = tables(spark, sf, "documents")["documents"]
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = language.Detector(language.learn(d.filter(~held_out), "text", "lang"))
    return d.select("doc_id", "lang", held_out.alias("held_out"), language.detect(F.col("text"), found).alias("detected"))


# ---- streams ----


@query("SELECT page_id AS item, (row_number() OVER (ORDER BY page_id) - 1)::INT AS \"offset\" FROM pages")
def paged_feed(spark, sf):
    steps = Steps(spark, "paged-feed")
    # Numbers in order: rows in ranges, then in their range behind the rows of those before.
    ranges = steps.written(tables(spark, sf, "pages")["pages"].select("page_id").repartitionByRange("page_id").withColumn("part", F.spark_partition_id()))
    sizes = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("page_id")) - 1 + F.col("before")
    numbered = ranges.join(before, "part").select(F.lit("all").alias("poi_id"), "page_id", rank.alias("rank"))
    place_pages.record(_recorded_calls(numbered), f"{steps.path}/feed")
    feed = place_pages.read(spark, f"{steps.path}/feed")
    return feed.select(F.col("item").cast("bigint").alias("item"), "offset")


def _recorded_calls(numbered, size=10):
    """Calls of ``size`` items each, in the order of the places' ranks; a call's token is its number, the last has no next one."""
    call = F.floor(F.col("rank") / size).cast("int")
    pages = numbered.groupBy("poi_id", call.alias("call")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "page_id"))), lambda x: x["page_id"].cast("string")).alias("items"))
    last = numbered.groupBy("poi_id").agg(F.max(call).alias("last"))
    following = F.when(F.col("call") < F.col("last"), (F.col("call") + 1).cast("string"))
    return pages.join(last, "poi_id").select("poi_id", "call", F.when(F.col("call") > 0, F.col("call").cast("string")).alias("token"), following.alias("next_token"), "items", F.lit(False).alias("failed"))


@query("SELECT (page_id % 40)::VARCHAR AS poi_id, page_id AS item, (row_number() OVER (PARTITION BY page_id % 40 ORDER BY page_id) - 1)::INT AS \"offset\" FROM pages")
def place_stream(spark, sf):
    """Feeds of 40 places in two runs of a stream: each place goes on at its own call."""
    steps = Steps(spark, "place-stream")
    own = (F.col("page_id") % 40).cast("string")
    p = tables(spark, sf, "pages")["pages"].select(own.alias("poi_id"), "page_id", (F.row_number().over(Window.partitionBy(own).orderBy("page_id")) - 1).alias("rank"))
    calls = steps.written(_recorded_calls(p))
    early = F.col("call") <= F.col("poi_id").cast("int") % 3
    for part in (calls.filter(early), calls.filter(~early)):
        place_pages.record(part, f"{steps.path}/feed")
        rows = place_pages.stream(spark, f"{steps.path}/feed").select("poi_id", F.col("item").cast("bigint").alias("item"), "offset")
        out = rows.writeStream.format("parquet").option("path", f"{steps.path}/out").option("checkpointLocation", f"{steps.path}/checkpoint")
        out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("poi_id string, item bigint, offset int").parquet(f"{steps.path}/out")


_PROGRESS = """WITH RECURSIVE e AS (SELECT user_id AS poi_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CASE event_id % 4 WHEN 0 THEN 'error' ELSE 'page' END AS kind, CASE WHEN event_id % 3 = 0 THEN 0 ELSE (event_id % 11)::INT END AS n FROM events),
r AS (SELECT poi_id, 0::BIGINT AS i, 0 AS next_offset, 0 AS error_streak, 0 AS pages, 0 AS reviews FROM (SELECT DISTINCT poi_id FROM e) d UNION ALL
SELECT r.poi_id, e.i, CASE WHEN kind = 'page' THEN next_offset + 10 ELSE next_offset END, CASE WHEN kind = 'error' OR n = 0 THEN error_streak + 1 ELSE 0 END, CASE WHEN kind = 'page' THEN pages + 1 ELSE pages END, CASE WHEN kind = 'page' THEN reviews + n ELSE reviews END
FROM r JOIN e ON e.poi_id = r.poi_id AND e.i = r.i + 1 WHERE r.error_streak < 3)
SELECT poi_id::VARCHAR AS poi_id, next_offset, error_streak, pages, reviews, error_streak >= 3 AS exhausted FROM (SELECT *, row_number() OVER (PARTITION BY poi_id ORDER BY i DESC) AS k FROM r) x WHERE k = 1"""


@query(_PROGRESS)
def feed_progress(spark, sf):
    return ingest.fold_progress(_fetches(spark, sf))


def _fetches(spark, sf):
    e = tables(spark, sf, "events")["events"]
    kind = F.when(F.col("event_id") % 4 == 0, "error").otherwise("page")
    return e.select(F.col("user_id").cast("string").alias("poi_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("event_id") % 11).cast("int").alias("n_reviews"))


@query(_PROGRESS)
def tracked_progress(spark, sf):
    """The same by keyed state, in two runs of a stream over growing files, read from the state."""
    steps = Steps(spark, "tracked-progress")
    fetches = _fetches(spark, sf)
    half = fetches.agg(F.percentile_approx("seq", 0.5)).head()[0] or 0
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, progress.PROVIDER)
    try:
        for part in (F.col("seq") <= half, F.col("seq") > half):
            fetches.filter(part).write.mode("append").parquet(f"{steps.path}/events")
            seen = progress.track(spark.readStream.schema(progress.EVENTS).parquet(f"{steps.path}/events"), wait_ms=86_400_000, most_wait_ms=86_400_000)
            progress.catch_up(spark, seen.writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{steps.path}/checkpoint"))
    finally:
        spark.conf.set(name, before)
    return progress.progress_table(spark, f"{steps.path}/checkpoint")
