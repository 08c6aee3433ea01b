"""Existence of a point in a time window, without a range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR = 3_600_000


def exists_within(
    left: DataFrame, at: Column, points: DataFrame, point: Column, hours_before: int, hours_after: int, name: str
) -> DataFrame:
    """Add boolean ``name``: some point lies strictly between ``at - before`` and ``at + after``.

    Points shrink to min and max per hour before any join. A window always covers its
    inner hours whole, so one point anywhere in them is enough; only the two edge hours
    need the max (lower edge) and the min (upper edge). Each non-empty point hour is
    listed under every ``at`` hour it can serve, which gives one row per hour: the join
    is an equi-join on the hour and its right side never exceeds the hours of the span.
    """
    ms = F.unix_millis(point)
    hourly = (
        points.filter(point.isNotNull())
        .groupBy(F.floor(ms / HOUR).alias("_ph"))
        .agg(F.min(ms).alias("_lo"), F.max(ms).alias("_hi"))
    )
    reach = F.sequence(F.lit(-hours_after), F.lit(hours_before)).alias("_reach")
    served = (
        hourly.select("*", F.explode(reach).alias("_d"))
        .groupBy((F.col("_ph") + F.col("_d")).alias("_hour"))
        .agg(
            F.max(F.when(F.col("_d") == hours_before, F.col("_hi"))).alias("_lower_edge_max"),
            F.min(F.when(F.col("_d") == -hours_after, F.col("_lo"))).alias("_upper_edge_min"),
            F.max((F.col("_d") > -hours_after) & (F.col("_d") < hours_before)).alias("_inside"),
        )
    )
    t = F.unix_millis(at)
    hit = (
        F.coalesce(F.col("_inside"), F.lit(False))
        | F.coalesce(F.col("_lower_edge_max") > t - hours_before * HOUR, F.lit(False))
        | F.coalesce(F.col("_upper_edge_min") < t + hours_after * HOUR, F.lit(False))
    )
    return (
        left.withColumn("_at_hour", F.floor(t / HOUR))
        .join(served, F.col("_at_hour") == F.col("_hour"), "left")
        .select(*left.columns, hit.alias(name))
    )
