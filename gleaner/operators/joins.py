"""Lookups, link explosion, templates and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions.text import filled_template, first_filled
from gleaner.operators.dedupe import first_wins, last_wins

#: Clusters of one part of a place and anchor, about, of which pairs are made.
PART = 2_000
#: Fixed search templates: intent, template, whether aliases are used too.
TEMPLATES = [
    ("planning", "{poi} tips", True),
    ("planning", "visiting {poi} tomorrow", True),
    ("planning", "first time at {poi}", True),
    ("planning", "what to know before {poi}", True),
    ("worth_it", "is {poi} worth it", True),
    ("worth_it", "should I skip {poi}", False),
    ("worth_it", "is {poi} overrated", True),
    ("logistics", "{poi} skip the line", False),
    ("logistics", "best time {poi}", False),
    ("logistics", "{poi} tickets", False),
    ("sub_experience", "{poi} guided tour worth it", False),
    ("sub_experience", "{poi} audio guide", False),
    ("regret", "{poi} mistake", False),
    ("regret", "wish I knew {poi}", False),
    ("regret", "{poi} tourist trap", False),
    ("hidden", "hidden gems {poi}", False),
    ("hidden", "underrated {poi}", False),
    ("hidden", "lesser known {poi}", False),
    ("nearby", "things to do near {poi}", False),
    ("nearby", "after visiting {poi}", False),
    ("nearby", "walking distance {poi}", False),
    ("food", "where to eat near {poi}", False),
    ("food", "restaurants near {poi}", False),
    ("food", "coffee near {poi}", False),
    ("photo", "best photo {poi}", False),
    ("photo", "sunset {poi}", False),
    ("demographic", "{poi} with kids", False),
    ("demographic", "wheelchair {poi}", False),
    ("trip_report", "{poi} trip report", True),
    ("trip_report", "just got back from {poi}", True),
    ("trip_report", "my experience at {poi}", True),
]


def with_place(rows: DataFrame, pois: DataFrame, key: str = "poi_id") -> DataFrame:
    """Rows beside their place's name and city, where there is one."""
    return rows.join(pois.select(F.col("id").alias(key), F.col("name").alias("poi_name"), "city"), key, "left")


def with_parent(children: DataFrame, parents: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Children beside their parent; orphans go by default."""
    return children.join(parents, key, how)


def linked_items(links: DataFrame, items: DataFrame, link_key: str, item_key: str, once: bool) -> DataFrame:
    """Items that links name: each once, or once for each link."""
    if once:
        return items.join(links.select(F.col(link_key).alias("_l")), F.col(item_key) == F.col("_l"), "left_semi")
    return links.select(F.col(link_key).alias("_l")).join(items, F.col("_l") == F.col(item_key)).drop("_l")


def missing(candidates: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return candidates.join(known.select(key), key, "left_anti")


def link_explosion(found: DataFrame, posts: DataFrame, comments: DataFrame) -> DataFrame:
    """For every way (found: post_id and provenance columns) that a post was found: a row for it and for each comment."""
    ways = [c for c in found.columns if c != "post_id"]
    own = found.join(posts.select(F.col("id").alias("post_id")), "post_id")
    of_posts = own.select(F.col("post_id").alias("item_id"), F.lit("post").alias("item_type"), *ways)
    of_comments = own.join(comments.select(F.col("id").alias("_c"), "post_id"), "post_id").select(F.col("_c").alias("item_id"), F.lit("comment").alias("item_type"), *ways)
    return of_posts.unionByName(of_comments)


def raw_lookup(rows: DataFrame, raw: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Rows beside the raw row of equal source and id; the last of duplicates counts."""
    own = last_wins(raw.withColumn("source_id", F.col("source_id").cast("string")), ["source", "source_id"], [order])
    return rows.join(own.select("source", "source_id", *[F.col(c).alias(f"raw_{c}") for c in columns]), ["source", "source_id"], "left")


def cluster_of_members(clusters: DataFrame, columns: list[str]) -> DataFrame:
    """flat_idx and the columns of the first cluster that has it, by cluster_id."""
    rows = clusters.select("cluster_id", *columns, F.explode("member_indices").alias("flat_idx"))
    return first_wins(rows, ["flat_idx"], ["cluster_id"])


def one_raw(raw: DataFrame, columns: list[str]) -> DataFrame:
    """One row of each source and source_id: the last by ``raw_order`` where there is such a column, ties and else the smallest."""
    whole = F.struct(*columns)
    key = F.struct(-F.col("raw_order"), whole) if "raw_order" in raw.columns else F.struct(whole)
    return raw.groupBy("source", "source_id").agg(F.min_by(whole, key).alias("_r")).select("source", "source_id", "_r.*")


def fill_urls(citations: DataFrame, raw: DataFrame) -> DataFrame:
    """Blank addresses are looked up by source and id; repeated raw rows count once.

    Only raw rows that a citation without an address names are grouped."""
    blank = citations.filter(F.coalesce("source_url", F.lit("")) == "").select("source", "source_id")
    own = one_raw(raw.join(blank, ["source", "source_id"], "left_semi"), ["source_url"]).withColumnRenamed("source_url", "_url")
    return citations.join(own, ["source", "source_id"], "left").withColumn("source_url", F.coalesce(F.nullif("source_url", F.lit("")), "_url")).drop("_url")


def default_left(rows: DataFrame, results: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """Rows beside a batch's results; missing values get defaults."""
    out = rows.join(results, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), v) for c, v in defaults.items()})


def anchor_pairs(clusters: DataFrame, distance: Column, least: float, part: int = PART) -> DataFrame:
    """Pairs of one place's clusters that share an anchor and are near: candidates come from an equi-join on anchors.

    The clusters of a place and anchor are cut into parts of about ``part`` by hash, and each part meets each in a cell of its
    own, so no task holds more than two parts at once.  A pair is taken at the first anchor that it shares, so pairs aren't
    collected to be told apart; only those of ids that several rows have are."""
    several = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("cluster_id", F.lit(True).alias("_again"))
    own = clusters.withColumn("anchors", F.array_distinct("anchors")).join(several, "cluster_id", "left")
    rows = own.withColumn("anchor", F.explode("anchors"))
    sizes = rows.groupBy("poi_name", "anchor").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("_parts"))
    rows = rows.join(sizes, ["poi_name", "anchor"]).withColumns({"_own": F.pmod(F.xxhash64("cluster_id"), F.col("_parts")).cast("int"), "_other": F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))})
    same = (F.col("x.poi_name") == F.col("y.poi_name")) & (F.col("x.anchor") == F.col("y.anchor")) & (F.col("x._own") == F.col("y._other")) & (F.col("x._other") == F.col("y._own"))
    first = (F.size("x.anchors") == 1) | (F.col("x.anchor") == F.array_min(F.array_intersect("x.anchors", "y.anchors")))

    def pairs(x: DataFrame, y: DataFrame) -> DataFrame:
        near = same & (F.col("x.cluster_id") < F.col("y.cluster_id")) & (distance < least) & first
        return x.alias("x").join(y.alias("y"), near).select(F.col("x.cluster_id").alias("a"), F.col("y.cluster_id").alias("b"))

    once, again = rows.filter("_again IS NULL"), rows.filter("_again")
    return pairs(once, once).unionByName(pairs(again, rows).unionByName(pairs(once, again)).distinct())


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Each key with where it is found: both, first or second."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_a").isNull(), "second").when(F.col("_b").isNull(), "first").otherwise("both")
    return x.join(y, key, "full_outer").select(key, side.alias("found_in"))


def search_queries(spark: SparkSession, pois: DataFrame, templates: list[tuple[str, str, bool]] | None = None) -> DataFrame:
    """intent_category and query_term of every template and name; aliases where the template says so.  Queries that
    differ only in case are one, the first.  Templates are a fixed list, so they are exploded, not cross-joined."""
    rows = [F.struct(F.lit(k).alias("t"), F.lit(i).alias("intent_category"), F.lit(q).alias("template"), F.lit(a).alias("use_aliases")) for k, (i, q, a) in enumerate(templates or TEMPLATES)]
    df = pois.select("name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.explode(F.array(*rows)).alias("r")).select("name", "aliases", "r.*")
    names = F.when(F.col("use_aliases"), F.concat(F.array("name"), F.array_except("aliases", F.array("name")))).otherwise(F.array("name"))
    df = df.select("name", "t", "intent_category", "template", F.posexplode(names).alias("k", "poi"))
    df = df.select("name", "t", "k", "intent_category", filled_template(F.col("template"), F.col("poi")).alias("query_term"))
    return first_wins(df, ["name", "intent_category", F.lower("query_term")], ["t", "k"]).drop("t", "k")


def evidence(clusters: DataFrame, insights: DataFrame, raw: DataFrame, most: int = 5) -> DataFrame:
    """Up to ``most`` quotes of each cluster: its central members first, then the others, in order; one of each source
    before any second of a source.  Members without a raw text give none; repeated raw rows and insights count once.

    The members come first: of insights and raw rows only those that they name are grouped, however many there are."""
    from gleaner.functions.text import trim_quote

    if most < 1:
        raise ValueError("at least one quote")
    none = F.array().cast("array<bigint>")
    ordered = F.concat(F.coalesce("centroid_text_indices", none), F.array_except(F.coalesce("member_indices", none), F.coalesce("centroid_text_indices", none)))
    rows = clusters.select("cluster_id", F.posexplode(ordered).alias("pos", "flat_idx"))
    members = insights.select("flat_idx", "source", "source_id", "anchor_entity").join(rows.select("flat_idx"), "flat_idx", "left_semi").dropDuplicates(["flat_idx"])
    rows = rows.join(members, "flat_idx")
    named = raw.filter("text <> ''").join(members.select("source", "source_id"), ["source", "source_id"], "left_semi")
    own = one_raw(named, ["text", "rating", "source_url"]).withColumnRenamed("text", "_text")
    rows = rows.join(own, ["source", "source_id"])
    again = F.row_number().over(Window.partitionBy("cluster_id", "source").orderBy("pos"))
    rows = rows.withColumn("_again", again > 1)
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy("_again", "pos"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= most).select("cluster_id", "rank", "source", "source_id", "rating", "source_url", "anchor_entity", trim_quote(F.col("_text")).alias("raw_text"))


def attach_mechanical(insights: DataFrame, raw: DataFrame, clusters: DataFrame, as_of: str) -> DataFrame:
    """Insights beside what their raw row and cluster tell: rating, helpful votes and date (of one platform only),
    language and freshness."""
    from gleaner.functions.scores import freshness

    df = raw_lookup(insights, raw, "raw_order", ["rating", "helpful_count", "created_at", "language"])
    labels = ["l1", "l2", "l3", "sentiment", "quality_tier"]
    df = df.join(cluster_of_members(clusters, labels), "flat_idx", "left")
    advisor = F.col("source") == "tripadvisor_review"
    df = df.withColumns(
        {
            "rating": F.coalesce("rating", "raw_rating"),
            "helpful_count": F.when(advisor, F.col("raw_helpful_count")),
            "created_at": F.when(advisor, F.col("raw_created_at")),
            "language": first_filled(F.when(F.col("source") == "google_review", F.col("raw_language")), F.lit("en")),
        }
    )
    return df.withColumn("freshness_score", freshness(F.col("created_at"), as_of)).drop("raw_rating", "raw_helpful_count", "raw_created_at", "raw_language")
