"""Whole-unit time differences and half-up rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MS_PER_HOUR = 3_600_000
MS_PER_DAY = 86_400_000


def diff_ms(later: Column, earlier: Column) -> Column:
    return F.unix_millis(later) - F.unix_millis(earlier)


def diff_hours(later: Column, earlier: Column) -> Column:
    """Whole hours, truncated toward zero (a cast to bigint truncates)."""
    return (diff_ms(later, earlier) / MS_PER_HOUR).cast("long")


def diff_days(later: Column, earlier: Column) -> Column:
    return (diff_ms(later, earlier) / MS_PER_DAY).cast("long")


def round2(value: Column) -> Column:
    """Two decimals, halves upward."""
    return F.floor(value * 100 + 0.5) / 100


def sunday_of(ts: Column) -> Column:
    """Date of the Sunday that opens the week of ``ts``."""
    return F.date_sub(F.date_trunc("week", F.date_add(ts.cast("date"), 1)).cast("date"), 1)


def coerce_timestamp(raw: Column) -> Column:
    """ISO text, else numeric text as epoch seconds, else the epoch itself."""
    return F.coalesce(
        F.try_to_timestamp(raw),
        F.timestamp_seconds(raw.try_cast("double")),
        F.timestamp_seconds(F.lit(0)),
    )
