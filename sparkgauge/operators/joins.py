"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 200_000  # rows of a key that one task may get; a key with more is cut into that many parts
MOST_HOT = 4096  # hot keys at most, so that their list can be broadcast


def left_join_hot_right(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``left.join(right, keys, "left")`` as an inner join plus the left rows without a match.

    In a left join Spark can neither broadcast the left side nor split a skewed right key.
    The inner join allows both: a small left side is broadcast and the right side is not
    shuffled, and otherwise adaptive execution splits the hot key on either side. The rest
    is an anti join against the distinct keys, which combine map-side.
    """
    keys = list(keys)
    found = left.join(right, keys)
    alone = left.join(right.select(*keys).distinct(), keys, "left_anti")
    missing = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in right.columns if c not in keys]
    return found.unionByName(alone.select(*left.columns, *missing))


def hot_keys(rows: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """(keys, parts): keys with more than ``hot_rows`` rows, and more than 1 / MOST_HOT of all, and how many parts they get.

    The counts combine map-side; fewer than MOST_HOT keys can hold that share.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("rows"))
    least = F.greatest(F.lit(hot_rows), counts.agg((F.sum("rows") / MOST_HOT).cast("long")).scalar())
    return counts.filter(F.col("rows") > least).select(*keys, F.ceil(F.col("rows") / least).cast("int").alias("parts"))


def skew_join(many: DataFrame, few: DataFrame, keys: Sequence[str], how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``many.join(few, keys, how)`` for ``inner`` and ``left``, where keys of ``many`` may be hot or null.

    Only hot keys are salted: their rows of ``many`` go to one of the key's parts by a hash of
    the whole row, and their rows of ``few`` to every part. Rows with a null key match
    nothing; they never enter the shuffle, whatever their number.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unknown join {how!r}")
    keys = list(keys)
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    known = many.filter(~null)
    hot = F.broadcast(hot_keys(known, keys, hot_rows))  # MOST_HOT rows at most
    taken = {c.lower() for c in [*many.columns, *few.columns, "parts"]}
    salt = "salt"
    while salt in taken:
        salt += "_"
    parts: Column = F.coalesce("parts", F.lit(1))
    left = known.join(hot, keys, "left").withColumn(salt, F.pmod(F.xxhash64(*known.columns), parts).cast("int")).drop("parts")
    right = few.join(hot, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    found = left.join(right, [*keys, salt], how).drop(salt)
    if how == "inner":
        return found
    missing = [F.lit(None).cast(few.schema[c].dataType).alias(c) for c in few.columns if c not in keys]
    return found.unionByName(many.filter(null).select(*many.columns, *missing))
