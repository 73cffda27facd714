"""Dates of reviews and videos as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import strip

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def visit_month(c: Column) -> Column:
    """``Jun 2026`` or ``June 2026`` as ``2026-06-01``; null for other texts."""
    pattern = r"^([A-Za-z]{3,9})\s+(\d{4})"
    own = strip(c)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(F.regexp_extract(own, pattern, 1), 1, 3)))
    return F.when(month > 0, F.concat(F.regexp_extract(own, pattern, 2), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-01")))


def epoch_iso(seconds: Column) -> Column:
    """Epoch seconds as ISO time in UTC."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def iso_time(c: Column) -> Column:
    return c.try_cast("timestamp")


def deep_link(video_id: Column, start_ms: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), video_id, F.lit("&t="), F.floor(start_ms / 1000).cast("string"), F.lit("s"))
