"""Date and time helpers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

HOUR_MICROS = 3_600_000_000
DAY_MICROS = 24 * HOUR_MICROS


def day_from_suffix(c: Column) -> Column:
    return F.to_date(c, "yyyyMMdd")


def sunday_week(day: Column) -> Column:
    """First day (Sunday) of the week of ``day``; Spark's own week truncation starts on Monday."""
    return F.date_sub(day, F.dayofweek(day) - 1)


def whole_seconds(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("SECOND", earlier, later)


def weekly_dates(start: dt.date, end: dt.date) -> Column:
    return F.sequence(F.lit(start), F.lit(end), F.expr("INTERVAL 7 DAYS"))
