"""String functions as column expressions.  White space means Unicode white space, as in ``str.strip``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ``\\s`` matches in Unicode mode, plus the separators x1C to x1F that ``str.strip`` also takes.
_WS = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{_WS}+|{_WS}+\z", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{_WS}+", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){_WS}+\z", "")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space."""
    return F.regexp_replace(c, rf"(?U){_WS}+", " ")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def maps_url(place_id: Column) -> Column:
    return F.concat(F.lit("https://www.google.com/maps/place/?q=place_id:"), place_id)


def page_url(base: Column, offset: Column) -> Column:
    """The address of a review page: ``-or{offset}-`` follows the first ``-Reviews``; offset 0 is the base.

    A negative offset or an address without the segment raises."""
    cut = F.locate("-Reviews-", base)
    after = cut + len("-Reviews-")
    spliced = F.concat(F.substring(base, F.lit(1), after - 1), F.lit("or"), offset.cast("string"), F.lit("-"), F.substring(base, after, F.length(base)))
    return (
        F.when(offset < 0, F.raise_error(F.concat(F.lit("offset must not be negative: "), offset.cast("string"))).cast("string"))
        .when(offset == 0, base)
        .when(cut == 0, F.raise_error(F.concat(F.lit("no '-Reviews-' in "), base)).cast("string"))
        .otherwise(spliced)
    )


def thread_id(url: Column) -> Column:
    """The bare post id in a thread's address, lower case; null without one."""
    return blank_to_null(F.lower(F.regexp_extract(url, "(?i)/comments/([a-z0-9]+)", 1)))


def thread_key(url: Column) -> Column:
    """``r/community/id`` of a thread's address, lower case; null unless a delimiter or the end follows the id."""
    found = F.regexp_extract(url, r"(?i)/r/([^/]+)/comments/([a-z0-9]+)(?:/|$)", 0)
    return F.when(found != "", F.concat(F.lit("r/"), F.lower(F.regexp_extract(found, r"(?i)/r/([^/]+)/", 1)), F.lit("/"), thread_id(found)))


def plain_url(url: Column) -> Column:
    """Without query and closing slashes, lower case."""
    return F.lower(F.rtrim(F.substring_index(url, "?", 1), F.lit("/")))


def digest_id(prefix: str, sha: Column, size: int) -> Column:
    return F.concat(F.lit(prefix), F.substring(sha, 1, size))


def synthetic_review_id(author: Column, body: Column, visit: Column, written: Column) -> Column:
    """An id for reviews without a link, equal under changes of case and white space: of the author, the first 200
    characters of the body and both dates."""

    def norm(c: Column) -> Column:
        return F.lower(squeeze(strip(F.coalesce(c, F.lit("")))))

    parts = [norm(author), F.substring(norm(body), 1, 200), norm(visit), norm(written)]
    return digest_id("syn_", F.sha2(F.concat_ws("|", *parts), 256), 16)


def stable_id(prefix: str, *parts: Column) -> Column:
    return digest_id(f"{prefix}_", F.sha1(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])), 12)


def clean_markdown(md: Column) -> Column:
    """Images and heading marks go, links keep their text."""
    no_images = F.regexp_replace(F.coalesce(md, F.lit("")), r"!\[[^\]]*\]\([^)]+\)", "")
    return F.regexp_replace(F.regexp_replace(no_images, r"\[([^\]]+)\]\([^)]+\)", "$1"), r"(?m)^#+\s*", "")


def matched_chars(text: Column, pattern: str) -> Column:
    """Characters inside matches of a pattern."""
    return F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(0), lambda a, m: a + F.length(m))


def trim_quote(text: Column, most: int = 400) -> Column:
    """At most ``most`` characters, cut at the last space unless that loses two fifths, with an ellipsis."""
    own = strip(F.coalesce(text, F.lit("")))
    head = F.substring(own, 1, most)
    # The place of the last space, counted from 0; -1 without one.
    space = F.when(F.locate(" ", F.reverse(head)) > 0, most - F.locate(" ", F.reverse(head))).otherwise(F.lit(-1))
    cut = F.when(space < int(most * 0.6), F.lit(most)).otherwise(space)
    return F.when(F.length(own) <= most, own).otherwise(F.concat(rstrip(F.substring(own, F.lit(1), cut)), F.lit("…")))


def joined(separator: str, *parts: Column) -> Column:
    """The filled parts with a separator between them."""
    return F.concat_ws(separator, *[blank_to_null(p) for p in parts])


def anchor_key(anchor: Column) -> Column:
    return F.lower(strip(F.coalesce(anchor, F.lit(""))))


def without_prefix(c: Column, prefix: str) -> Column:
    return F.when(F.startswith(c, F.lit(prefix)), F.substring(c, F.lit(len(prefix) + 1), F.length(c))).otherwise(c)


def community_name(c: Column) -> Column:
    """Lower case, without a leading ``r/`` (the prefix only: ``r/rome`` is ``rome``)."""
    return without_prefix(F.lower(c), "r/")


def minutes(anchor: Column) -> Column:
    """Minutes of the first number with a unit of minutes or hours; a comma is a decimal point; null without one."""
    pattern = r"(?i)\b(\d+(?:[.,]\d+)?)\s*(min(?:ute)?s?|hours?|hrs?)\b"
    value = F.replace(F.regexp_extract(anchor, pattern, 1), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(F.lower(F.regexp_extract(anchor, pattern, 2)).startswith("h"), value * 60).otherwise(value)


def contained(hay: Column, needles: Column) -> Column:
    """The needles that a text contains, without regard to case."""
    low = F.lower(F.coalesce(hay, F.lit("")))
    return F.filter(needles, lambda n: F.contains(low, F.lower(n)))


def mentions_any(text: Column, terms: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(low, F.lit(t.lower()))
    return found


def filled_template(template: Column, name: Column) -> Column:
    return F.replace(template, F.lit("{poi}"), name)


def humanized(name: Column) -> Column:
    """Underscores become spaces, the first letter a capital, and a sentence mark ends the text."""
    own = squeeze(F.replace(strip(F.coalesce(name, F.lit(""))), F.lit("_"), F.lit(" ")))
    capital = F.concat(F.upper(F.substring(own, 1, 1)), F.substring(own, F.lit(2), F.length(own)))
    closed = F.when(capital.rlike(r"[.?!]$"), capital).otherwise(F.concat(capital, F.lit(".")))
    return F.when(F.coalesce(name, F.lit("")) == "", "An observation worth noting.").otherwise(closed)


def short_id(c: Column) -> Column:
    """The first and last four characters of ids longer than 14; a dash for none."""
    short = F.concat(F.left(c, F.lit(4)), F.lit("…"), F.right(c, F.lit(4)))
    return F.when(F.coalesce(c, F.lit("")) == "", "—").when(F.length(c) <= 14, c).otherwise(short)


def year(*cols: Column) -> Column:
    """The first year 19xx or 20xx in the first filled value."""
    return blank_to_null(F.regexp_extract(first_filled(*cols), r"\b((?:19|20)\d{2})\b", 1))


def iso_day(c: Column) -> Column:
    """The first yyyy-mm-dd in a text, else its first ten characters."""
    found = F.regexp_extract(c, r"\d{4}-\d{2}-\d{2}", 0)
    return F.coalesce(F.when(found != "", found).otherwise(F.substring(c, 1, 10)), F.lit(""))


def source_label(source: Column, community: Column, channel: Column) -> Column:
    """How a quote's source is named to readers, by what the source's name contains."""
    low = F.lower(F.coalesce(source, F.lit("")))
    has = {k: F.contains(low, F.lit(k)) for k in ("tripadvisor", "google", "reddit", "youtube")}
    filled = {k: F.coalesce(c, F.lit("")) != "" for k, c in (("community", community), ("channel", channel))}
    return (
        F.when(has["tripadvisor"], "TripAdvisor reviewer")
        .when(has["google"], "Google reviewer")
        .when(has["reddit"] & filled["community"], F.concat(F.lit("Reddit r/"), without_prefix(community, "r/")))
        .when(has["reddit"], "Reddit")
        .when(has["youtube"] & filled["channel"], F.concat(F.lit("YouTube — "), channel))
        .when(has["youtube"], "YouTube transcript")
        .when(low != "", F.replace(low, F.lit("_"), F.lit(" ")))
        .otherwise("Reviewer")
    )


#: Fixed platform names.
PLATFORMS = {
    "reddit_post": "Reddit Post",
    "reddit_comment": "Reddit Comment",
    "youtube_transcript_chunk": "YouTube",
    "tripadvisor_review": "TripAdvisor",
    "google_review": "Google Reviews",
}


def platform(source: Column) -> Column:
    pairs = [F.lit(x) for kv in PLATFORMS.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), source), source)


def human_size(n: Column) -> Column:
    """Bytes in the first unit of which there are fewer than 1024."""
    value, out = n.cast("double"), None
    for power, unit in enumerate(("B", "KB", "MB", "GB")):
        text = F.concat(F.format_string("%.1f", F.bround(value / 1024**power, 1)), F.lit(f" {unit}"))
        fits = value < 1024 ** (power + 1)
        out = F.when(fits, text) if out is None else out.when(fits, text)
    return out.otherwise(F.concat(F.format_string("%.1f", F.bround(value / 1024**4, 1)), F.lit(" TB")))
