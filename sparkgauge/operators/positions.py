"""Row positions and top rows that stay distributed when one group is huge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgauge.session import checkpointed


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Add ``position`` (from 0) and ``total`` per key, with no task owning a whole key.

    Rows are range-partitioned by (keys, order) and sorted, so a hot key spreads over
    many partitions. The sorted rows are checkpointed: the partition layout is then
    fixed, and the index inside a partition plus the row counts of the key in earlier
    partitions gives the position. Rows that tie in ``order`` get different positions in
    no stated order; with a unique order reruns agree.
    """
    columns = df.columns
    sort = [F.col(k) for k in keys] + list(order)
    rows = checkpointed(df.repartitionByRange(*sort).sortWithinPartitions(*sort))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    rows = rows.select(
        *columns,
        F.shiftright("_row", 33).alias("_part"),
        F.col("_row").bitwiseAND((1 << 33) - 1).alias("_idx"),
    )
    # one row per (key, partition holding it)
    runs = rows.groupBy(*keys, "_part").agg(F.min("_idx").alias("_first"), F.count("*").alias("_n"))
    per_key = Window.partitionBy(*keys)
    earlier = per_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_part").alias("_run_part"),
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(per_key).alias("total"),
    )
    on = F.col("_part") == F.col("_run_part")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(runs, on).select(
        *columns, (F.col("_idx") + F.col("_shift")).alias("position"), "total"
    )


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows of each key. Spark trims each partition to ``n`` rows per key
    before the shuffle, so a hot key costs n rows per partition."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
