"""Scores and ratings as column expressions.  Rounding is half to even throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the ranking.
RANK_WEIGHTS = {"cosine": 0.55, "tier": 0.25, "source_diversity": 0.15, "size_sigmoid": 0.05, "anchor_bonus": 0.10}
INSIGHT_RANK_WEIGHTS = {"cosine": 1.0, "cluster_tier": 0.10, "freshness": 0.05}
TIER_WEIGHT = {"A": 1.0, "B": 0.6, "C": 0.3}
TIER_RANK = {"A": 0, "B": 1, "C": 2}
SIZE_CENTER, SIZE_SCALE = 20, 10
INTENT_MISMATCH_PENALTY = 0.04
POSITIVE_INTENT_TOKENS = [
    "worth", "best", "should i see", "recommend", "highlight", "must", "favorite", "favourite",
    "great", "love", "amazing", "prioritize", "priority", "hidden", "gem", "seek",
]
NEGATIVE_INTENT_TOKENS = [
    "avoid", "scam", "rude", "bad", "warning", "complaint", "problem", "tourist trap", "ripoff",
    "ripped off", "dirty", "annoying",
]
TAU_SECONDS = 2 * 365.25 * 24 * 3600


def rating(raw: Column) -> Column:
    """A whole rating of a number or its text; null if it is neither."""
    return F.bround(raw.try_cast("double"), 0).cast("int")


def video_score(views: Column, likes: Column, comments: Column) -> Column:
    seen = F.greatest(views, F.lit(1)).cast("double")
    reach = F.least(views / 500_000.0, F.lit(1.0))
    liked = F.least(likes / seen / 0.05, F.lit(1.0))
    discussed = F.least(comments / seen / 0.01, F.lit(1.0))
    return F.bround(0.5 * reach + 0.3 * liked + 0.2 * discussed, 4)


def size_sigmoid(size: Column) -> Column:
    return 1.0 / (1.0 + F.exp((F.lit(float(SIZE_CENTER)) - size) / float(SIZE_SCALE)))


def tier_weight(tier: Column) -> Column:
    return _mapped(tier, TIER_WEIGHT, 0.3)


def tier_rank(tier: Column) -> Column:
    return _mapped(tier, TIER_RANK, 99)


def _mapped(c: Column, values: dict, default) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(default))


def diversity(n_sources: Column) -> Column:
    return F.least(n_sources / 5.0, F.lit(1.0))


def hybrid(cosine: Column, tier: Column, n_sources: Column, size: Column, anchor: Column | None = None, clash: Column | None = None) -> Column:
    w = RANK_WEIGHTS
    score = w["cosine"] * cosine + w["tier"] * tier_weight(tier) + w["source_diversity"] * diversity(n_sources) + w["size_sigmoid"] * size_sigmoid(size)
    if anchor is not None:
        score = score + w["anchor_bonus"] * anchor
    return score if clash is None else score - INTENT_MISMATCH_PENALTY * clash


def insight_score(cosine: Column, tier: Column, freshness_: Column) -> Column:
    w = INSIGHT_RANK_WEIGHTS
    return w["cosine"] * cosine + w["cluster_tier"] * tier_weight(tier) + w["freshness"] * F.coalesce(freshness_, F.lit(0.0))


def query_intent(query: str, word_bounded: bool = False) -> str | None:
    """``positive`` or ``negative`` if the query holds tokens of that list alone.  Tokens are found inside words too
    unless ``word_bounded``."""
    import re

    low = query.lower()
    hit = (lambda t: re.search(rf"\b{re.escape(t)}\b", low)) if word_bounded else low.__contains__
    good, bad = any(map(hit, POSITIVE_INTENT_TOKENS)), any(map(hit, NEGATIVE_INTENT_TOKENS))
    return None if good == bad else "positive" if good else "negative"


def intent_clash(intent: str | Column | None, sentiment: Column) -> Column:
    """1.0 where a cluster's sentiment goes against the query's intent, which may be a column."""
    own = F.coalesce(sentiment, F.lit("neutral"))
    if isinstance(intent, Column):
        return F.when(((intent == "positive") & own.isin("negative", "mixed")) | ((intent == "negative") & (own == "positive")), 1.0).otherwise(0.0)
    if intent is None:
        return F.lit(0.0)
    return F.when(own.isin("negative", "mixed") if intent == "positive" else own == "positive", 1.0).otherwise(0.0)


def anchor_match(query: str | Column, anchors: Column, poi: Column) -> Column:
    """1.0 where an anchor other than the place's own name stands in the query as whole words."""
    low = F.lower(query) if isinstance(query, Column) else F.lit(query.lower())
    own = F.filter(F.coalesce(anchors, F.array().cast("array<string>")), lambda a: (a != "") & (F.lower(a) != F.lower(F.coalesce(poi, F.lit("")))))
    hit = F.exists(own, lambda a: F.rlike(low, F.concat(F.lit(r"(?U)\b\Q"), F.lower(a), F.lit(r"\E\b"))))
    return F.when(hit, 1.0).otherwise(0.0)


def quality_tier(named: Column, actionable: Column, size: Column) -> Column:
    best = F.greatest(named, actionable)
    return F.when(((best >= 4) & (size >= 3)) | (size >= 15), "A").when((best >= 3) | (size >= 8), "B").otherwise("C")


def freshness(created: Column, as_of: str) -> Column:
    """Exponential decay with the age at a given time; 0.5 without a readable time, 1 for the future."""
    then = created.try_cast("timestamp")
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) / 1e6 - F.unix_micros(then) / 1e6
    return F.when(then.isNull(), 0.5).when(age <= 0, 1.0).otherwise(F.exp(-age / TAU_SECONDS))


def verdict(tier_a: Column, clusters: Column, positive: Column, warnings: Column, insights: Column) -> Column:
    """A place's score from 0 to 100; shares of nothing are 0."""

    def share(n: Column, of: Column) -> Column:
        return F.when(of > 0, n / of).otherwise(0.0)

    raw = 100 * (0.5 * share(tier_a, clusters) + 0.3 * share(positive, insights) + 0.2 * (1 - share(warnings, insights)))
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(raw, 0).cast("int")))


#: The least score of each headline, and the headlines of the second band by place.
HEADLINES = [(85, "An unambiguous yes."), (70, None), (55, "Worth it — barely."), (None, "Skip it, or plan very carefully.")]
SECOND_BAND = {"Colosseum": "Go, with conditions.", None: "Yes, but never on a Saturday."}
NO_SCORE = "Verdict pending."


def verdict_headline(score: Column, poi: Column) -> Column:
    """A headline for a score's band."""
    second = F.lit(SECOND_BAND[None])
    for name, text in SECOND_BAND.items():
        second = second if name is None else F.when(poi == name, text).otherwise(second)
    out = F.when(score.isNull(), NO_SCORE)
    for least, text in HEADLINES:
        text = second if text is None else F.lit(text)
        out = out.otherwise(text) if least is None else out.when(score >= least, text)
    return out


def cost(n: Column, rate: float) -> Column:
    return F.bround(n * rate, 4)
