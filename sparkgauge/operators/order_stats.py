"""Order statistics by refining histograms: nothing is sorted but the bucket that holds the wanted rank.

A group's rows are counted per bucket of the order, a running count over the buckets
(bounded per group, whatever the number of rows) finds the one that holds the rank, and
only its rows are looked at again, in narrower buckets. Counts combine map-side, so a
group with a third of all rows costs no task more than its buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgauge.session import scratch_path

# Of microseconds: buckets of 72 minutes, then of 4 ms. The last level below these is exact.
TIME_SHIFTS = (32, 12)
ID_LETTERS = 4  # rows of one instant are told apart by so many letters of their ids before they are ranked
BINS = 64  # of the coarse histogram of values, for each doubling


def _same(left: Sequence[str], prefix: str) -> Column:
    """Null-safe equality of columns and their prefixed twins."""
    out = F.lit(True)
    for name in left:
        out = out & F.col(name).eqNullSafe(F.col(prefix + name))
    return out


def _free(columns: Sequence[str], stem: str) -> str:
    """A prefix that no column starts with."""
    while any(c.lower().startswith(stem.lower()) for c in columns):
        stem += "_"
    return stem


def _micros() -> Column:
    return F.coalesce(F.unix_micros(F.col("date").cast("timestamp")), F.lit(-(1 << 62)))


def time_bucket() -> Column:
    """The widest bucket of ``date``, by which ``halves`` counts first."""
    return F.shiftright(_micros(), TIME_SHIFTS[0])


def halves(points: DataFrame, keys: Sequence[str] = (), counts: DataFrame | None = None) -> DataFrame:
    """(keys, n, a, b): rows, and means of ``value`` over the earlier floor(n / 2) rows and over the others.

    ``points`` has (keys, date, id, value); rows are ordered by date, then by id as text,
    nulls first. Null values take a place and do not count in the means. Rows that agree
    in date and id may fall on either side. No rows give no result, also without keys.

    Points are read twice: to be counted by ``time_bucket``, unless the caller has done so
    (``counts``: keys, code, n, c values that are not null, s their sum), and to set aside
    those of the bucket in the middle of their group, which are all that is looked at again.
    """
    x = _free(keys, "p_")
    code, name, value, level = x + "code", x + "name", x + "value", x + "level"
    rows = points.select(
        *keys, _micros().alias(code), F.coalesce(F.col("id").cast("string"), F.lit("")).alias(name), F.col("value").cast("double").alias(value)
    )
    buckets = [F.struct(F.shiftright(code, s).alias("code"), F.lit("").alias("name")) for s in TIME_SHIFTS]
    buckets.append(F.struct(F.col(code).alias("code"), F.substring(name, 1, ID_LETTERS).alias("name")))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    upto = group.orderBy("code", "name").rowsBetween(Window.unboundedPreceding, 0)
    found: list[DataFrame] = []  # per level: what is certainly early
    want = x + "want"
    for depth, bucket in enumerate(buckets):
        if depth == 0 and counts is not None:
            counted = counts.select(*keys, "code", F.lit("").alias("name"), "n", "c", "s")
        else:
            sums = [F.count("*").alias("n"), F.count(value).alias("c"), F.sum(value).alias("s"), *([F.first(want).alias(want)] if depth else [])]
            counted = rows.withColumn(level, bucket).groupBy(*keys, f"{level}.code", f"{level}.name").agg(*sums)
        counted = counted.withColumns({m + "_upto": F.sum(m).over(upto) for m in "ncs"})
        if not depth:
            counted = counted.withColumns({m + "_all": F.sum(m).over(group) for m in "ncs"})
            counted = counted.withColumn(want, F.floor(F.col("n_all") / 2))
            totals = counted.groupBy(*keys).agg(*[F.first(f"{m}_all").alias(f"{m}_all") for m in "ncs"])
        before = F.col("n_upto") - F.col("n")
        chosen = counted.filter((before < F.col(want)) & (F.col(want) <= F.col("n_upto")))
        chosen = chosen.select(
            *keys, "code", "name", (F.col(want) - before).alias("left_over"),
            (F.col("c_upto") - F.col("c")).alias("c"), (F.coalesce("s_upto", F.lit(0.0)) - F.coalesce("s", F.lit(0.0))).alias("s"),
        )
        found.append(chosen.select(*keys, "c", "s"))
        twin = chosen.select(*[F.col(k).alias(x + k) for k in keys], F.col("code").alias(x + "c"), F.col("name").alias(x + "n"), F.col("left_over").alias(x + "w"))
        rows = rows.drop(want).withColumn(level, bucket)
        rows = rows.join(twin, _same(keys, x) & (F.col(f"{level}.code") == F.col(x + "c")) & (F.col(f"{level}.name") == F.col(x + "n")))
        rows = rows.select(*keys, code, name, value, F.col(x + "w").alias(want))
        if not depth:  # the rows of one bucket a group
            path = scratch_path(points.sparkSession, "middle")
            rows.write.parquet(path)
            rows = points.sparkSession.read.schema(rows.schema).parquet(path)
    place = F.row_number().over(group.orderBy(code, name))
    last = rows.withColumn(x + "place", place).filter(F.col(x + "place") <= F.col(want))
    found.append(last.groupBy(*keys).agg(F.count(value).alias("c"), F.sum(value).alias("s")))
    parts = [totals] + [f.select(*keys, F.col("c").alias("c_early"), F.col("s").alias("s_early")) for f in found]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    got = stacked.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n_all", "c_all", "s_all", "c_early", "s_early")]).filter("n_all is not null")
    early, c_early = F.coalesce("s_early", F.lit(0.0)), F.coalesce("c_early", F.lit(0))
    return got.select(
        *keys,
        F.col("n_all").alias("n"),
        F.try_divide(early, c_early).alias("a"),
        F.try_divide(F.coalesce("s_all", F.lit(0.0)) - early, F.col("c_all") - c_early).alias("b"),
    )


def counted_percentiles(counts: DataFrame, keys: Sequence[str], shares: Mapping[str, float]) -> DataFrame:
    """(keys, one column per share): linear interpolation between the ranks around ``share * (n - 1)``.

    ``counts`` has (keys, value, n), a row per distinct value; null values must not be in it.
    """
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    running = counts.withColumn("upto", F.sum("n").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)))
    running = running.withColumn("total", F.sum("n").over(group))

    def at(rank: Column) -> Column:
        """The value in place ``rank``, counted from 0."""
        return F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank), F.col("value")))

    total = F.col("total") - 1
    ends = {}
    for name, share in shares.items():
        rank = total * F.lit(share)
        ends |= {f"{name}_low": at(F.floor(rank)), f"{name}_high": at(F.ceil(rank)), f"{name}_part": F.max(rank - F.floor(rank))}
    got = running.groupBy(*keys).agg(*[c.alias(n) for n, c in ends.items()])
    between = [(F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * F.col(f"{n}_part")).alias(n) for n in shares]
    return got.select(*keys, *between)


def percentiles(df: DataFrame, keys: Sequence[str], value: Column, shares: Mapping[str, float]) -> DataFrame:
    """(keys, one column per share) of ``value``, which is taken as a double; 0 where a group has no value.

    A first pass counts values in bins of one per cent of their size; a second one counts
    the distinct values of the bins that hold a wanted rank, and only those. The other bins
    are one row each, which stands for their count.
    """
    x = _free([*df.columns, *keys], "p_")
    v, cell, one = x + "value", x + "bin", x + "one"
    asked, rows = list(keys), df.select(*keys, value.cast("double").alias(v))
    if not keys:
        keys, rows = [one], rows.withColumn(one, F.lit(1))
    step = (F.floor(F.log2(F.abs(v)) * BINS) + (1 << 20)).cast("long")  # log2 of a double lies between -1075 and 1024
    placed = F.when(F.col(v) > 0, step).when(F.col(v) < 0, -step).when(F.isnan(v), F.lit(1 << 21)).otherwise(0)
    binned = rows.filter(F.col(v).isNotNull()).select(*keys, v, placed.alias(cell))
    coarse = binned.groupBy(*keys, cell).agg(F.count("*").alias("n"), F.min(v).alias("value"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    coarse = coarse.withColumn("upto", F.sum("n").over(group.orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)))
    coarse = coarse.withColumn("total", F.sum("n").over(group) - 1)
    wanted = F.lit(False)
    for share in shares.values():
        for rank in (F.floor(F.col("total") * share), F.ceil(F.col("total") * share)):
            wanted = wanted | ((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank))
    coarse = coarse.withColumn("wanted", wanted)
    twin = coarse.filter("wanted").select(*[F.col(k).alias(x + k) for k in keys], F.col(cell).alias(x + "at"))
    fine = binned.join(twin, _same(keys, x) & (F.col(cell) == F.col(x + "at"))).groupBy(*keys, F.col(v).alias("value")).agg(F.count("*").alias("n"))
    counts = fine.unionByName(coarse.filter("not wanted").select(*keys, "value", "n"))
    got = counted_percentiles(counts, keys, shares)
    # groups without any value
    none = rows.select(*keys).distinct() if asked else df.sparkSession.range(1).select(F.lit(1).alias(one))
    stacked = got.unionByName(none, allowMissingColumns=True)
    zeroed = stacked.groupBy(*keys).agg(*[F.coalesce(F.max(n), F.lit(0.0)).alias(n) for n in shares])
    return zeroed.select(*asked, *shares)
