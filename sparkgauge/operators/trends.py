"""Direction of a measure over time, and weekly means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgauge.functions.timefns import sunday_of
from sparkgauge.operators.order_stats import halves


def trend(points: DataFrame, keys: Sequence[str] = (), lower_is_better: bool | str = False) -> DataFrame:
    """Compare the mean of the earlier half with the mean of the later half.

    ``points`` has (keys, date, id, value). Under four points, or a change below 10 %,
    the trend is ``stable``. A zero base counts as 1. ``lower_is_better`` is a flag or
    the name of a boolean key column. Output: keys, trend.
    """
    lower = F.col(lower_is_better) if isinstance(lower_is_better, str) else F.lit(lower_is_better)
    return halves(points, keys).select(*keys, direction(F.col("n"), F.col("a"), F.col("b"), lower).alias("trend"))


def direction(n: Column, first_mean: Column, second_mean: Column, lower_is_better: Column) -> Column:
    """Trend from the number of points and the means of the two halves."""
    base = F.when(first_mean == 0, 1.0).otherwise(first_mean)
    change = (second_mean - first_mean) / base * 100
    return (
        F.when((n < 4) | (F.abs(change) < 10), "stable")
        .when((change < 0) == lower_is_better, "improving")
        .otherwise("declining")
    )


def weekly_series(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and count of ``value`` per Sunday week; empty weeks between are 0.

    Points collapse to one row per week before the gaps are filled, so the window and the
    filling work on weeks, not on points.
    """
    weekly = points.groupBy(*keys, sunday_of(F.col("date")).alias("_week")).agg(
        F.avg("value").alias("_mean"), F.count("*").alias("_n")
    )
    weekly = weekly.filter(F.col("_week").isNotNull())
    following = F.lead("_week").over(Window.partitionBy(*keys).orderBy("_week"))
    weekly = weekly.withColumn("_last", F.coalesce(F.date_sub(following, 7), F.col("_week")))
    filled = weekly.withColumn("week", F.explode(F.expr("sequence(_week, _last, interval 7 days)")))
    own = F.col("week") == F.col("_week")
    return filled.select(
        *keys,
        "week",
        F.when(own, F.col("_mean")).otherwise(0.0).alias("value"),
        F.when(own, F.col("_n")).otherwise(0).alias("n"),
    )
