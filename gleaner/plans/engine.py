"""The query interface over a warm store: searches, lists, evidence and rollups as lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import scores
from gleaner.functions.taxonomy import VALID_L1
from gleaner.operators import cleaning, joins, rollups, search, vectors
from gleaner.operators.sampling import top_per_group

TOP_K = 50
#: How many candidates of a search diversity chooses from: twice the limit, ten at least.
POOL = 10


@dataclass
class Store:
    """clusters (with embedding), insights (with embedding) and raw rows."""

    clusters: DataFrame
    insights: DataFrame
    raw: DataFrame

    def warm(self) -> Store:
        for df in (self.clusters, self.insights, self.raw):
            df.cache()
        return self

    def reset(self) -> Store:
        for df in (self.clusters, self.insights, self.raw):
            df.unpersist()
        return self


def cluster_card(relevance: Column) -> list[Column]:
    """The columns of a cluster's card, with defaults."""
    text = lambda c, d: F.coalesce(c, F.lit(d)).alias(c)
    return [
        F.col("cluster_id"), F.col("poi_name"), F.col("name"), text("l1", ""), text("l2", ""), text("l3", ""), F.col("secondary_l1"),
        text("sentiment", "neutral"), text("quality_tier", "C"), F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("n_sources", F.lit(1)).alias("n_sources"),
        F.coalesce("anchor_entities", F.array().cast("array<string>")).alias("anchor_entities"), F.bround(relevance, 4).alias("relevance_score"),
        F.concat(F.lit("gleaner://cluster/"), F.col("cluster_id").cast("string")).alias("cluster_uri"),
    ]


def insight_card() -> list[Column]:
    """The columns of an insight's card: its own values, where they are blank those of its cluster (``c_``), else defaults."""
    own = lambda c, *rest: F.coalesce(F.nullif(F.col(c), F.lit("")), *rest).alias(c)
    return [
        "flat_idx", F.coalesce("poi_name", F.lit("")).alias("poi_name"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("source"), "source_id", "rating",
        *[own(c, F.col(f"c_{c}"), F.lit("")) for c in ("l1", "l2", "l3")], own("insight_sentiment", F.nullif("sentiment", F.lit(""))), "intent_tag",
        F.coalesce("numeric_anchors", F.array().cast("array<string>")).alias("numeric_anchors"), "sub_attraction", F.coalesce("cluster_id", "c_id").alias("cluster_id"), "cluster_name",
        F.bround("score", 4).alias("relevance_score"),
    ]


class Engine:
    def __init__(self, store: Store, places: list[str] | None = None):
        self.store, self.places = store, places

    def _check(self, poi: str, l1: str | None = None, tier: str | None = None) -> None:
        if self.places is not None and poi not in self.places:
            raise ValueError(f"poi must be one of {sorted(self.places)}; got {poi!r}")
        if l1 is not None and l1 not in VALID_L1:
            raise ValueError(f"l1 must be one of {sorted(VALID_L1)}; got {l1!r}")
        if tier is not None and tier not in scores.TIER_RANK:
            raise ValueError(f"tier must be A, B or C; got {tier!r}")

    def ranked_clusters(self, poi: str, query: str, vector: list[float], l1: str | None = None, min_tier: str = "B") -> DataFrame:
        """The clusters nearest to the query's vector, then scored: filters come before scores, the two limits stay apart."""
        self._check(poi, l1, min_tier)
        own = self.store.clusters.filter((F.col("poi_name") == poi) & cleaning.has_intent(l1) & cleaning.tier_at_least(F.col("quality_tier"), min_tier))
        q = F.array(*[F.lit(float(x)) for x in vector])
        near = own.withColumn("cosine", F.round(vectors.cosine(F.col("embedding"), q), 9)).orderBy(F.desc("cosine"), "cluster_id").limit(TOP_K)
        score = scores.hybrid(
            F.col("cosine"), F.coalesce("quality_tier", F.lit("C")), F.coalesce("n_sources", F.lit(1)), F.coalesce("size", F.lit(0)),
            scores.anchor_match(query, F.col("anchor_entities"), F.col("poi_name")), scores.intent_clash(scores.query_intent(query), F.col("sentiment")),
        )
        return near.withColumn("score", F.round(score, 9))

    def search_clusters(self, poi: str, query: str, vector: list[float], l1: str | None = None, limit: int = 5, min_tier: str = "B") -> DataFrame:
        pool = self.ranked_clusters(poi, query, vector, l1, min_tier).orderBy(F.desc("score"), "cluster_id").limit(max(2 * limit, POOL))
        return vectors.rerank_diverse(pool, "poi_name", "score", "embedding", "cluster_id", limit).orderBy("rank").select("rank", *cluster_card(F.col("score")))

    def search_insights(self, poi: str, vector: list[float], filters: dict | None = None, limit: int = 10) -> DataFrame:
        self._check(poi)
        own = self.store.insights.filter((F.col("poi_name") == poi) & cleaning.insight_filter(filters))
        q = F.array(*[F.lit(float(x)) for x in vector])
        near = own.withColumn("cosine", F.round(vectors.cosine(F.col("embedding"), q), 9)).orderBy(F.desc("cosine"), "flat_idx").limit(TOP_K)
        parent = self.store.clusters.select("cluster_id", F.col("quality_tier").alias("_tier"), F.col("name").alias("cluster_name"))
        both = near.join(parent, "cluster_id", "left")
        score = scores.insight_score(F.col("cosine"), F.coalesce("_tier", F.lit("C")), F.col("freshness_score"))
        return both.withColumn("score", F.round(score, 9)).orderBy(F.desc("score"), "flat_idx").limit(limit).drop("_tier", "embedding")

    def insight_cards(self, poi: str, vector: list[float], filters: dict | None = None, limit: int = 10) -> DataFrame:
        """The hits of ``search_insights`` as cards; hits without a cluster stay.  Columns that the store lacks are null."""
        hits = self.search_insights(poi, vector, filters, limit)
        missing = {c: F.lit(None).cast(t) for c, t in {"text": "string", "l3": "string", "sentiment": "string", "numeric_anchors": "array<string>"}.items() if c not in hits.columns}
        parent = self.store.clusters.select(F.col("cluster_id").alias("c_id"), *[F.col(c).alias(f"c_{c}") for c in ("l1", "l2", "l3")])
        both = (hits.withColumns(missing) if missing else hits).join(parent, F.col("cluster_id") == F.col("c_id"), "left")
        return both.orderBy(F.desc("score"), "flat_idx").select(*insight_card())

    def list_concerns(self, poi: str, category: str | None = None, limit: int = 10) -> DataFrame:
        self._check(poi)
        own = self.store.clusters.filter((F.col("poi_name") == poi) & cleaning.has_intent("Operational Intelligence") & F.col("sentiment").isin("negative", "mixed"))
        own = own if category is None else own.filter(F.col("l2") == category)
        weight = F.coalesce("size", F.lit(0)) * scores.diversity(F.coalesce("n_sources", F.lit(1)))
        return own.withColumn("weight", weight).orderBy(F.desc("weight"), "cluster_id").limit(limit).select(*cluster_card(F.lit(0.0)))

    def list_highlights(self, poi: str, intent: str | None = None, limit: int = 10) -> DataFrame:
        self._check(poi, intent)
        own = self.store.clusters.filter((F.col("poi_name") == poi) & (F.col("quality_tier") == "A") & (F.col("sentiment") == "positive") & cleaning.has_intent(intent))
        score = F.round(scores.hybrid(F.lit(1.0), F.col("quality_tier"), F.coalesce("n_sources", F.lit(1)), F.coalesce("size", F.lit(0))), 9)
        return own.withColumn("score", score).orderBy(F.desc("score"), "cluster_id").limit(limit).select(*cluster_card(F.lit(0.0)))

    def explain_cluster(self, cluster_id: int, max_quotes: int = 5) -> DataFrame:
        return joins.evidence(self.store.clusters.filter(F.col("cluster_id") == cluster_id), self.store.insights, self.store.raw, max_quotes).orderBy("rank")

    def poi_stats(self, poi: str | None = None) -> DataFrame:
        out = rollups.poi_stats(self.store.clusters, self.store.insights)
        return out if poi is None else out.filter(F.col("poi_name") == poi)

    def sub_attractions(self, poi: str | None = None, min_mentions: int = 2, sentiment: str | None = None) -> DataFrame:
        own = self.store.insights if poi is None else self.store.insights.filter(F.col("poi_name") == poi)
        own = own if sentiment is None else own.filter(F.col("insight_sentiment") == sentiment)
        return rollups.sub_attractions(own, min_mentions)

    def pois(self) -> DataFrame:
        return rollups.poi_summary(self.store.clusters)

    def health(self) -> DataFrame:
        return rollups.health(self.store.clusters, self.store.insights, self.places)

    def ranked_many(self, queries: list[dict]) -> DataFrame:
        """``ranked_clusters`` of many queries (poi, query, vector; l1 and min_tier if there are) in one scan of the clusters, with
        their place in the list as ``query_no``."""
        asked = []
        for k, q in enumerate(queries):
            tier = q.get("min_tier", "B")
            self._check(q["poi"], q.get("l1"), tier)
            asked.append(search.Query(k, q["poi"], q["vector"], scores.TIER_RANK[tier], q.get("l1")))
        tier = scores.tier_rank(F.coalesce("quality_tier", F.lit("C")))
        near = search.nearest(self.store.clusters, asked, TOP_K, "cluster_id", "embedding", "poi_name", tier, (F.col("l1"), F.col("secondary_l1")))
        said = self._asked([(k, q["query"], scores.query_intent(q["query"])) for k, q in enumerate(queries)], "query_no int, query string, intent string")
        both = near.join(self.store.clusters, "cluster_id").join(said, "query_no")
        anchored, clash = scores.anchor_match(F.col("query"), F.col("anchor_entities"), F.col("poi_name")), scores.intent_clash(F.col("intent"), F.col("sentiment"))
        score = scores.hybrid(F.col("cosine"), F.coalesce("quality_tier", F.lit("C")), F.coalesce("n_sources", F.lit(1)), F.coalesce("size", F.lit(0)), anchored, clash)
        return both.withColumn("score", F.round(score, 9)).drop("query", "intent")

    def _asked(self, rows: list[tuple], schema: str) -> DataFrame:
        """The caller's list of queries as a table, which goes to every executor."""
        return F.broadcast(self.store.clusters.sparkSession.createDataFrame(rows, schema))

    def sweep(self, poi: str, queries: list[tuple[str, list[float]]], limit: int = 5) -> DataFrame:
        """Several searches in one scan; the first hit of a cluster counts."""
        from gleaner.operators.dedupe import first_wins

        ranked = self.ranked_many([{"poi": poi, "query": q, "vector": v} for q, v in queries])
        hits = top_per_group(ranked, ["query_no"], [F.desc("score"), F.asc("cluster_id")], limit)
        return first_wins(hits.select("cluster_id", "name", "score", "query_no"), ["cluster_id"], ["query_no"])

    def answer(self, poi: str, query: str, vector: list[float], limit: int = 3) -> DataFrame:
        """A deterministic answer: the best clusters with their quotes."""
        hits = self.search_clusters(poi, query, vector, limit=limit).select("rank", "cluster_id", "name")
        quotes = joins.evidence(self.store.clusters.join(F.broadcast(hits.select("cluster_id")), "cluster_id", "left_semi"), self.store.insights, self.store.raw, 3)
        return hits.join(quotes.withColumnRenamed("rank", "quote_rank"), "cluster_id", "left").orderBy("rank", "quote_rank")

    def evaluate(self, golden: list[dict]) -> DataFrame:
        """Golden queries (poi, query, vector, expected_l1, must_mention): whether the label is among the first three and a
        term in the names or quotes.  All queries are one plan, with one scan of the clusters."""
        from gleaner.functions.text import contained

        want = self._asked([(k, g["query"], g["expected_l1"] or None, list(g["must_mention"])) for k, g in enumerate(golden)], "query_no int, query string, expected_l1 string, terms array<string>")
        pool = top_per_group(self.ranked_many(golden), ["query_no"], [F.desc("score"), F.asc("cluster_id")], POOL, "_place").drop("_place")
        hits = vectors.rerank_diverse(pool.select("query_no", "cluster_id", "name", "l1", "score", "embedding"), "query_no", "score", "embedding", "cluster_id", POOL // 2)
        first = hits.filter("rank <= 3").select("query_no", "cluster_id")
        names = hits.join(want, "query_no").groupBy("query_no").agg(F.concat_ws(" ", F.collect_list("name")).alias("names"), F.max((F.col("rank") <= 3) & (F.col("l1") == F.col("expected_l1"))).alias("l1_hit"), F.count(F.lit(1)).alias("n_hits"))
        quotes = joins.evidence(self.store.clusters.join(first, "cluster_id", "left_semi"), self.store.insights, self.store.raw, 3)
        texts = first.join(quotes.select("cluster_id", "raw_text"), "cluster_id").groupBy("query_no").agg(F.concat_ws(" ", F.collect_list("raw_text")).alias("quotes"))
        out = want.join(names, "query_no", "left").join(texts, "query_no", "left").withColumn("matched_terms", contained(F.concat_ws(" ", "names", "quotes"), F.col("terms")))
        l1_hit = F.col("expected_l1").isNull() | F.coalesce("l1_hit", F.lit(False))
        text_hit = (F.size("terms") == 0) | (F.size("matched_terms") > 0)
        return out.select("query_no", "query", (l1_hit & text_hit).alias("passed"), "matched_terms", F.coalesce("n_hits", F.lit(0)).alias("n_hits"))

    def tool(self, name: str, **arguments) -> DataFrame:
        """The dispatch table of an agent's tools."""
        tools = {
            "list_pois": self.pois,
            "search_clusters": self.search_clusters,
            "search_insights": self.search_insights,
            "insight_cards": self.insight_cards,
            "explain_cluster": self.explain_cluster,
            "list_concerns": self.list_concerns,
            "list_highlights": self.list_highlights,
        }
        if name not in tools:
            raise ValueError(f"no tool {name!r}")
        return tools[name](**arguments)
