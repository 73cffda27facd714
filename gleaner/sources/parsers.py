"""Parsers from recorded responses to rows: pure projections over JSON structs, maps and markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import scores
from gleaner.functions.dates import epoch_iso
from gleaner.functions.text import first_filled, strip, synthetic_review_id, without_prefix
from gleaner.operators.dedupe import first_wins

#: Fixed names of sort modes in the two review interfaces.
SORT_MODES = {"mostRelevant": "most_relevant", "newest": "newest", "highestRanking": "highest", "lowestRanking": "lowest"}
MONTH_NAMES = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"


def _zero(c: Column | str) -> Column:
    return F.coalesce(c, F.lit(0))


def review_pages(pages: DataFrame) -> DataFrame:
    """Review pages (``reviews`` array) as reviews; those without an id go."""
    r = pages.select(F.explode("reviews").alias("r")).filter("r.review_id <> ''")
    return r.select(
        "r.review_id",
        F.col("r.user.name").alias("author"),
        scores.rating(F.col("r.rating").cast("string")).alias("rating"),
        first_filled(F.col("r.snippet"), F.col("r.extracted_snippet.original")).alias("text"),
        F.col("r.date").alias("relative_time"),
        "r.iso_date",
        _zero("r.likes").alias("likes"),
    )


def review_items(items: DataFrame, sort_mode: str, order: str, min_chars: int = 75) -> DataFrame:
    """Review items as reviews: the first of an id counts, even if its text is then too short."""
    first = first_wins(items, ["reviewId"], [order], drop_empty=True).withColumn("text", strip(F.coalesce("text", F.lit(""))))
    return first.filter(F.length("text") >= min_chars).select(
        F.col("reviewId").alias("review_id"),
        F.col("name").alias("author"),
        scores.rating(F.col("stars").cast("string")).alias("rating"),
        "text",
        F.col("publishedAtDate").alias("iso_date"),
        _zero("likesCount").alias("likes"),
        F.col("isLocalGuide").alias("is_local_guide"),
        F.col("reviewerNumberOfReviews").alias("reviewer_review_count"),
        F.col("responseFromOwnerText").alias("owner_response"),
        F.col("reviewUrl").alias("review_url"),
        F.col("originalLanguage").alias("original_language"),
        F.lit(SORT_MODES.get(sort_mode, sort_mode)).alias("sort_mode"),
    )


def _after(text: Column, place: Column) -> Column:
    return F.substring(text, place, F.length(text))


def _before_match(text: Column, match: Column) -> Column:
    """What precedes the first place of a matched string; the whole text without one."""
    at = F.position(match, text)
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)


def _behind(text: Column, match: Column) -> Column:
    """What follows the first place of a matched string."""
    return _after(text, F.position(match, text) + F.length(match))


def markdown_reviews(pages: DataFrame, page_key: str, markdown: str = "markdown") -> DataFrame:
    """Reviews of markdown pages.  A page falls into segments at rules of three stars; a review has a rating in bubbles and
    a written date.  Its title is a link with the review's number, or else the first line behind the rating, and then the id
    is made from author, body and dates.  The author is the last profile link before the title; the body stands between the
    visit date and the first of ``Read more`` and ``Written``.  The first of equal ids in a page counts."""
    title = r"(?:###\s+)?\[[^\]]+\]\(https://www\.tripadvisor\.com/ShowUserReviews-[^)]*?-r\d+-[^)]*\)"
    author = r"\[([^\]]+)\]\(https://www\.tripadvisor\.com/Profile/([^)\s]+)\)"
    rating = r"(?i)(\d(?:\.\d)?)\s+of\s+5\s+bubbles"
    visit = rf"((?:{MONTH_NAMES})\s+\d{{4}})(?:\s+•\s+(\w+))?"
    written = r"(?U)Written\s+(\w+\s+\d{1,2},\s+\d{4})"
    col = F.col
    df = pages.select(page_key, F.posexplode(F.split(F.coalesce(markdown, F.lit("")), r"\n\s*\*\s*\*\s*\*\s*\n", -1)).alias("pos", "seg"))
    df = df.withColumns({"rating_text": F.regexp_extract("seg", rating, 0), "written_date": F.regexp_extract("seg", written, 1), "link": F.regexp_extract("seg", title, 0)})
    df = df.filter("rating_text <> '' AND written_date <> ''")
    rated = _behind(col("seg"), col("rating_text"))
    lines = F.filter(F.transform(F.split(rated, "\n", -1), strip), lambda x: x != "")
    plain = F.get(lines, F.lit(0))
    plain = F.when(plain.rlike(rf"^(?:{MONTH_NAMES})\s+\d{{4}}"), None).otherwise(plain)
    df = df.withColumns({"rated": rated, "plain": plain}).filter("link <> '' OR plain IS NOT NULL")
    linked = col("link") != ""
    before_plain = F.substring("seg", F.lit(1), F.length("seg") - F.length("rated"))
    df = df.withColumns(
        {
            "title": F.when(linked, strip(F.regexp_extract("link", r"\[([^\]]+)\]", 1))).otherwise(col("plain")),
            "before": F.when(linked, _before_match(col("seg"), col("link"))).otherwise(before_plain),
            "after": F.when(linked, _behind(col("seg"), col("link"))).otherwise(_behind(col("rated"), col("plain"))),
        }
    )
    profiles = F.regexp_extract_all("before", F.lit(author), F.lit(0))
    last = F.get(profiles, F.size(profiles) - 1)
    date = F.regexp_extract("after", visit, 0)
    rest = _behind(col("after"), col("visit"))
    ends = [F.when(F.locate(m, rest) > 0, F.locate(m, rest)) for m in ("\nRead more\n", "\nWritten ")]
    stop = F.coalesce(F.least(*ends), F.length(rest) + 1)
    body = strip(F.regexp_replace(F.substring(rest, F.lit(1), stop - 1), r"!\[[^\]]*\]\([^)]+\)", ""))
    filled = lambda c: F.nullif(c, F.lit(""))
    df = df.withColumns({"profile": last, "visit": date})
    df = df.withColumns(
        {
            "author": strip(F.regexp_extract("profile", author, 1)),
            "author_profile": F.regexp_extract("profile", author, 2),
            "rating": scores.rating(F.regexp_extract("rating_text", rating, 1)),
            "visit_date": filled(F.regexp_extract("visit", visit, 1)),
            "trip_type": filled(F.regexp_extract("visit", visit, 2)),
            "body": F.when(col("visit") != "", filled(body)),
        }
    )
    number = F.regexp_extract("link", r"-r(\d+)-", 1)
    made = synthetic_review_id(col("author"), col("body"), col("visit_date"), col("written_date"))
    df = df.withColumn("review_id", F.when(number != "", F.concat(F.lit("r"), number)).otherwise(made))
    out = first_wins(df, [page_key, "review_id"], ["pos"])
    return out.select(page_key, "pos", "review_id", "author", "author_profile", "rating", "title", "body", "visit_date", "trip_type", "written_date")


def thread_items(items: DataFrame, min_chars: int = 20) -> tuple[DataFrame, DataFrame]:
    """Interleaved thread items as posts and comments; comments carry their post's score.  Blank, deleted and short
    comments go."""
    bare = lambda own, other: first_filled(F.col(own), without_prefix(F.col(other), "t3_"))
    posts = items.filter("dataType = 'post'").select(
        bare("parsedId", "id").alias("reddit_id"), "title", F.col("body"), F.col("communityName").alias("community_name"), F.col("postUrl").alias("post_url"),
        "score", F.col("upvoteRatio").alias("upvote_ratio"), F.col("commentsCount").alias("comments_count"), F.col("engagementTotal").alias("engagement_total"),
        F.col("scorePerHour").alias("score_per_hour"), F.col("isHighEngagement").alias("is_high_engagement"), F.col("wordCount").alias("word_count"),
        F.col("subredditSubscribers").alias("subreddit_subscribers"), F.col("createdAt").alias("created_at_reddit"),
    )
    body = strip(F.coalesce("body", F.lit("")))
    own = items.filter("dataType = 'comment'").withColumns({"body": body, "parent_post_reddit_id": bare("parsedPostId", "postId")})
    own = own.filter((F.length("body") >= min_chars) & ~F.col("body").isin("[deleted]", "[removed]"))
    scored = posts.groupBy("reddit_id").agg(F.max("score").alias("post_score")).withColumnRenamed("reddit_id", "_post")
    comments = own.join(scored, F.col("parent_post_reddit_id") == F.col("_post"), "left").select(
        F.col("id").alias("reddit_id"), "body", "score", F.col("scorePerHour").alias("score_per_hour"), "depth", F.col("parentId").alias("parent_id"),
        F.col("parentKind").alias("parent_kind"), F.col("authorName").alias("author_name"), F.col("subredditName").alias("subreddit_name"),
        F.col("commentCreatedAt").alias("created_at_reddit"), "controversiality", F.col("ageHours").alias("age_hours"), F.col("isSubmitter").alias("is_submitter"),
        "post_score", F.col("url").alias("comment_url"), "parent_post_reddit_id",
    )
    return posts, comments


def video_rows(entries: DataFrame) -> DataFrame:
    duration = _zero("duration")
    return entries.select(
        F.col("id").alias("video_id"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.concat(F.lit("https://www.youtube.com/watch?v="), "id").alias("url"),
        F.when(duration <= 60, "short").otherwise("long").alias("format"),
        _zero("view_count").alias("views"),
        _zero("like_count").alias("likes"),
        _zero("comment_count").alias("comment_count"),
        duration.cast("int").alias("duration_seconds"),
        F.col("upload_date").alias("published_at"),
    )


def full_text(segments: Column) -> Column:
    return F.nullif(F.array_join(F.transform(segments, lambda s: s["text"]), " "), F.lit(""))


def caption_segments(events: Column) -> Column:
    """Caption events (tStartMs, dDurationMs, segs of utf8) as segments; events without text go."""

    def line(e: Column) -> Column:
        parts = F.transform(F.coalesce(e["segs"], F.array().cast("array<struct<utf8:string>>")), lambda s: F.coalesce(s["utf8"], F.lit("")))
        return strip(F.replace(F.array_join(parts, ""), F.lit("\n"), F.lit(" ")))

    rows = F.transform(events, lambda e: F.struct(_zero(e["tStartMs"]).alias("start_ms"), _zero(e["dDurationMs"]).alias("duration_ms"), line(e).alias("text")))
    return F.filter(rows, lambda s: s["text"] != "")


def actor_segments(raw: Column) -> Column:
    """Segments given as texts of seconds (start, dur, text) in milliseconds; unreadable and empty ones go."""
    ms = lambda c: F.bround(c.try_cast("double") * 1000, 6).cast("bigint")
    rows = F.transform(raw, lambda s: F.struct(ms(s["start"]).alias("start_ms"), ms(s["dur"]).alias("duration_ms"), strip(F.replace(F.coalesce(s["text"], F.lit("")), F.lit("\n"), F.lit(" "))).alias("text")))
    return F.filter(rows, lambda s: s["start_ms"].isNotNull() & s["duration_ms"].isNotNull() & (s["text"] != ""))


def video_comments(rows: DataFrame) -> DataFrame:
    own = rows.filter("id <> '' AND text <> ''")
    return own.select(F.col("id").alias("comment_id"), "video_id", "text", _zero("like_count").alias("likes"), epoch_iso(F.col("timestamp")).alias("published_at"))


_INSIGHT = "array<struct<text:string,strength:double,anchor_entity:string>>"


def flatten_insights(results: DataFrame, default_source: str) -> DataFrame:
    """A row per insight, with its review's lineage; reviews without insights give none."""
    rows = results.select("*", F.explode("insights").alias("i"))
    return rows.select(
        F.coalesce("source", F.lit(default_source)).alias("source"), "source_id", "poi_id", "poi_name", "rating",
        F.col("i.text").alias("text"), F.coalesce("i.strength", F.lit(0.5)).alias("strength"), F.col("i.anchor_entity").alias("anchor_entity"),
    )


def sane_insights(insights: Column) -> Column:
    """The first three of a model's insights, of which those with a text stay: a strength of 0 or none is 0.5, an empty
    anchor none."""
    kept = F.filter(F.slice(insights, 1, 3), lambda i: F.coalesce(i["text"], F.lit("")) != "")
    strength = lambda i: F.coalesce(F.nullif(i["strength"], F.lit(0.0)), F.lit(0.5))
    return F.transform(kept, lambda i: F.struct(i["text"].alias("text"), strength(i).alias("strength"), F.nullif(i["anchor_entity"], F.lit("")).alias("anchor_entity")))


def sane_tag(tag: Column) -> Column:
    """A model's tag with known values only."""
    from gleaner.operators.rollups import INTENTS, SENTIMENTS

    none = lambda c: F.when(F.lower(F.trim(c)).isin("", "null", "none"), None).otherwise(c)
    return F.struct(
        F.when(tag["insight_sentiment"].isin(SENTIMENTS), tag["insight_sentiment"]).otherwise("neutral").alias("insight_sentiment"),
        F.when(tag["intent_tag"].isin([*INTENTS, "other"]), tag["intent_tag"]).otherwise("other").alias("intent_tag"),
        F.filter(F.coalesce(tag["numeric_anchors"], F.array().cast("array<string>")), lambda a: a != "").alias("numeric_anchors"),
        none(tag["sub_attraction"]).alias("sub_attraction"),
        none(tag["visit_date_mentioned"]).alias("visit_date_mentioned"),
    )


def aligned(inputs: DataFrame, results: DataFrame, key: str = "id", pos: str = "pos") -> DataFrame:
    """A batch's results beside its inputs: by id, or by place for inputs whose id came back with none.

    Of results of one id, or of one place, the last counts, so an input is never multiplied."""
    by_id = results.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.max_by("result", F.struct(pos, "result")).alias("_by_id"))
    by_pos = results.groupBy(F.col(pos).alias("_pos")).agg(F.max("result").alias("_by_pos"))
    out = inputs.join(by_id, F.col(key) == F.col("_id"), "left").join(by_pos, F.col(pos) == F.col("_pos"), "left")
    return out.withColumn("result", F.coalesce("_by_id", "_by_pos")).drop("_id", "_pos", "_by_id", "_by_pos")


def item_kind(item: dict[str, Column]) -> Column:
    """post, comment or other, by the first rule that holds."""
    has = lambda k: F.coalesce(item[k].cast("string"), F.lit("")) != ""
    kind = first_filled(*[item[k] for k in ("dataType", "type", "__type__") if k in item])
    return (
        F.when(kind.isin("post", "submission") | has("postType"), "post")
        .when((kind == "comment") | has("commentId") | has("parentId"), "comment")
        .when(has("title") & has("url"), "post")
        .when(has("body") & ~has("title"), "comment")
        .otherwise("other")
    )


def discussion_links(results: DataFrame) -> DataFrame:
    """url, title and snippet of search results that lead to a discussion; other pages of the site or of others go."""
    url = F.coalesce("url", F.lit(""))
    return results.filter(F.contains(url, F.lit("reddit.com")) & F.contains(url, F.lit("/comments/"))).select("url", "title", F.col("description").alias("snippet"))


def numbered_lines(texts: Column, most: int = 700) -> Column:
    """Texts as numbered lines for a prompt, long ones cut with an ellipsis."""
    cut = lambda t: F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t)
    return F.array_join(F.transform(texts, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), cut(t))), "\n")


def compact_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))
