"""Performance bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bands from best to worst, and the limits of the first three.
LEVELS = ["elite", "high", "medium", "low"]
LEAD_TIME_HOURS = [24, 168, 720]
FAILURE_RATE_PERCENT = [5, 10, 15]
RECOVERY_HOURS = [1, 24, 168]


def _at_most(value: Column, limits: list[int]) -> Column:
    band = F.when(value <= limits[0], LEVELS[0])
    for limit, name in zip(limits[1:], LEVELS[1:]):
        band = band.when(value <= limit, name)
    return band.otherwise(LEVELS[3])


def level_frequency(per_day: Column) -> Column:
    """At least daily, weekly, monthly (30 days), or less."""
    return (
        F.when(per_day >= 1, "elite")
        .when(per_day >= 1 / 7, "high")
        .when(per_day >= 1 / 30, "medium")
        .otherwise("low")
    )


def level_lead_time(hours: Column) -> Column:
    return _at_most(hours, LEAD_TIME_HOURS)


def level_failure_rate(percent: Column) -> Column:
    return _at_most(percent, FAILURE_RATE_PERCENT)


def level_recovery(hours: Column) -> Column:
    return _at_most(hours, RECOVERY_HOURS)


def overall_level(*levels: Column) -> Column:
    """The worst of the given bands."""
    order = F.array(*[F.lit(x) for x in LEVELS])
    return F.element_at(order, F.greatest(*[F.array_position(order, x) for x in levels]).cast("int"))
