"""Filters and drop rules of pages, threads, videos and insights."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import scores
from gleaner.functions.text import lstrip, matched_chars, mentions_any, strip

#: Fixed words of page navigation.
NAVIGATION = [
    "menu", "search", "subscribe", "newsletter", "log in", "sign up", "home",
    "about", "contact", "privacy policy", "terms of service", "cookie",
    "follow us", "share", "tweet", "facebook", "instagram", "twitter",
    "© ", "all rights reserved", "skip to content", "advertisement",
]
_SKIPS = ("skip to main content", "skip to footer", "- skip to main content", "- skip to footer")
_ERROR_404 = r"(?iU)error\s*404|404\s*not\s*found|page\s*not\s*found"
_LINK = r"\[[^\]]*\]\([^)]*\)"


def is_404(text: Column) -> Column:
    return text.rlike(_ERROR_404)


def is_short_navigation(text: Column) -> Column:
    own = F.lower(lstrip(text))
    return reduce(lambda a, b: a | b, [F.startswith(own, F.lit(s)) for s in _SKIPS]) & (F.length(text) < 300)


def is_mostly_links(text: Column) -> Column:
    return F.coalesce(matched_chars(text, _LINK) / F.nullif(F.length(text), F.lit(0)) > 0.5, F.lit(False))


def page_drop(text: Column) -> Column:
    """Why a page is dropped, the first reason that holds; null if it stays."""
    own = F.coalesce(text, F.lit(""))
    return (
        F.when(strip(own) == "", "empty_text")
        .when(is_404(own), "error_404")
        .when(is_short_navigation(own), "nav_cruft_short")
        .when(F.length(own) < 250, "too_short_<250")
        .when(is_mostly_links(own), "mostly_md_links")
    )


def mentions_place(poi: Column, text: Column) -> Column:
    """Two places are known by several names; others by their own."""
    name = F.lower(F.coalesce(poi, F.lit("")))
    return (
        F.when(F.contains(name, F.lit("colosseum")) | F.contains(name, F.lit("coliseum")), text.rlike(r"(?iU)\b(colosseum|coliseum)\b"))
        .when(F.contains(name, F.lit("louvre")), text.rlike(r"(?iU)\b(louvre|mona\s*lisa)\b"))
        .when(name != "", F.contains(F.lower(text), name))
        .otherwise(False)
    )


def thread_drop(poi: Column, text: Column) -> Column:
    own = F.coalesce(text, F.lit(""))
    return F.when(strip(own) == "", "empty_text").when(F.length(own) < 100, "too_short_<100").when(~mentions_place(poi, own), "no_poi_term")


def is_navigation(chunk: Column, words: list[str] | None = None) -> Column:
    """Short, made of short lines, or short with a word of navigation (``NAVIGATION`` unless others are given)."""
    lines = F.filter(F.split(chunk, "\n", -1), lambda x: x.rlike(r"(?U)[^\s\x1c-\x1f]"))
    mean = _let(lines, lambda own: F.aggregate(own, F.lit(0), lambda a, x: a + F.length(x)) / F.nullif(F.size(own), F.lit(0)))

    def rule(low: Column) -> Column:
        word = reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in words or NAVIGATION])
        return (F.length(low) < 50) | ((F.length(low) < 200) & word) | F.coalesce(mean < 25, F.lit(False))

    return _let(F.lower(strip(chunk)), rule)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also inside lambdas, where Spark shares no common parts."""
    return F.transform(F.array(value), use)[0]


def long_enough(text: Column, n: int) -> Column:
    return F.coalesce(F.length(strip(text)) >= n, F.lit(False))


def engaging(views: Column, duration: Column, form: Column) -> Column:
    """Videos with enough views for their form, of at least half a minute."""
    return (views >= F.when(form == "short", 5_000).otherwise(10_000)) & (duration >= 30)


def in_communities(name: Column, allowed: list[str] | None) -> Column:
    """An optional allow-list, off by default."""
    return F.lit(True) if not allowed else F.lower(name).isin([a.lower() for a in allowed])


def accepted_comment(kept_parent: Column, text: Column, terms: list[str]) -> Column:
    """Comments of kept posts, and those that mention a term themselves."""
    return F.coalesce(kept_parent, F.lit(False)) | mentions_any(text, terms)


INSIGHT_FILTERS = ("l1", "l2", "rating_min", "rating_max", "source", "insight_sentiment", "intent_tag", "has_numeric", "sub_attraction", "cluster_id", "min_freshness")


def insight_filter(filters: dict | None) -> Column:
    """All given conditions; unknown keys are ignored, missing fields fail, empty lists don't filter."""
    f = {k: v for k, v in (filters or {}).items() if k in INSIGHT_FILTERS and v is not None}
    as_list = lambda v: [v] if isinstance(v, str) else list(v)
    sentiment = F.coalesce(F.nullif("insight_sentiment", F.lit("")), F.col("sentiment"))
    rules = {
        "l1": lambda v: F.col("l1") == v,
        "l2": lambda v: F.col("l2") == v,
        "rating_min": lambda v: F.col("rating").cast("int") >= int(v),
        "rating_max": lambda v: F.col("rating").cast("int") <= int(v),
        "source": lambda v: F.col("source").isin(as_list(v)) if v else F.lit(True),
        "insight_sentiment": lambda v: sentiment.isin(as_list(v)) if v else F.lit(True),
        "intent_tag": lambda v: F.col("intent_tag").isin(as_list(v)) if v else F.lit(True),
        "has_numeric": lambda v: F.size("numeric_anchors") > 0 if v is True else F.lit(True),
        "sub_attraction": lambda v: F.contains(F.lower("sub_attraction"), F.lit(v.lower())) if v else F.lit(True),
        "cluster_id": lambda v: F.col("cluster_id") == v,
        "min_freshness": lambda v: F.col("freshness_score") >= float(v),
    }
    return reduce(and_, [F.coalesce(rules[k](v), F.lit(False)) for k, v in f.items()], F.lit(True))


def has_intent(l1: str | None) -> Column:
    """Primary or secondary label; none asks for none."""
    return F.lit(True) if l1 is None else (F.col("l1").eqNullSafe(F.lit(l1)) | F.col("secondary_l1").eqNullSafe(F.lit(l1)))


def tier_at_least(tier: Column, least: str) -> Column:
    return scores.tier_rank(F.coalesce(tier, F.lit("C"))) <= scores.TIER_RANK.get(least, 2)


def recommended(recommendations: Column, positive: Column, negative: Column) -> Column:
    """Sights with enough recommendations and clearly more praise than blame."""
    return (recommendations >= 3) & (positive > 0.6 * negative)


def preferred_or_all(df: DataFrame, preferred: Column, group: list[str], k: int, order: list[Column]) -> DataFrame:
    """The first k preferred rows of a group; of all its rows where none is preferred."""
    from pyspark.sql.window import Window

    any_ = F.max(F.coalesce(preferred, F.lit(False)).cast("int")).over(Window.partitionBy(*group))
    kept = df.withColumn("_any", any_).filter((F.col("_any") == 0) | preferred)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k).drop("_any")


def schedulable(df: DataFrame, cap: int, skip: list[str]) -> DataFrame:
    """Places still to fetch: not exhausted, under the cap of reviews, not to be skipped."""
    return df.filter(~F.coalesce("exhausted", F.lit(False)) & (F.coalesce("n_reviews", F.lit(0)) < cap) & ~F.col("name").isin(skip or [""]))
