"""Epoch-second arithmetic. Days are integers on a shifted calendar, never time-zone lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400
#: A viewer's calendar may be at most 14 hours from UTC.
MAX_OFFSET_MINUTES = 14 * 60


def within(col: Column, days: int, now: int) -> Column:
    """P-10: the time lies in the last ``days`` days; 0 means no limit, NULL counts as 0."""
    if not days:
        return F.lit(True)
    return F.coalesce(col, F.lit(0)) >= F.lit(now - days * DAY)


def clamp_shift(offset_minutes: int) -> int:
    """Seconds east of UTC, limited to a real time zone."""
    return max(-MAX_OFFSET_MINUTES, min(offset_minutes, MAX_OFFSET_MINUTES)) * 60


def local_day(ts: Column, offset_minutes: int = 0) -> Column:
    """F-10: day number of an epoch second on the viewer's calendar."""
    return F.floor((ts + F.lit(clamp_shift(offset_minutes))) / F.lit(DAY)).cast("bigint")


def day_date(day: Column) -> Column:
    """F-10: ISO date of a day number."""
    return F.date_format(F.date_from_unix_date(day.cast("int")), "yyyy-MM-dd")


def next_reset(ts: Column) -> Column:
    """F-10: the UTC midnight after an epoch second."""
    return ((F.floor(ts / F.lit(DAY)) + 1) * F.lit(DAY)).cast("bigint")


def day_key(user: Column, ts: Column) -> Column:
    """F-10: key of one person's counter row for one UTC day."""
    return F.concat(F.lit("daily#"), user, F.lit("#"), day_date(local_day(ts)))


def day_span(now: int, days: int, offset_minutes: int, longest: int) -> tuple[int, int]:
    """First and last day number of the ``days`` days ending today."""
    days = max(1, min(days, longest))
    today = (now + clamp_shift(offset_minutes)) // DAY
    return today - days + 1, today


def day_spine(spark, now: int, days: int, offset_minutes: int, longest: int):
    """One row per day of the span, so that empty days stay in the result."""
    first, last = day_span(now, days, offset_minutes, longest)
    return spark.range(first, last + 1).withColumnRenamed("id", "day")


def epoch_seconds(value: Column) -> Column:
    """F-12: seconds from a value that may be in milliseconds."""
    whole = value.cast("bigint")
    return F.when(whole > 10_000_000_000, F.floor(whole / 1000)).otherwise(whole).cast("bigint")


def to_epoch(ts: Column) -> Column:
    """Whole epoch seconds of a timestamp column with or without a zone (UTC session)."""
    return F.unix_seconds(ts.cast("timestamp"))
