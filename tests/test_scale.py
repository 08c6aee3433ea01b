"""The helpers that keep hot groups spread, against brute force."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkgauge.operators import artifacts, matching, similarity
from sparkgauge.operators.intervals import exists_within
from sparkgauge.operators.joins import hot_keys, left_join_hot_right, skew_join
from sparkgauge.operators.order_stats import halves, percentiles
from sparkgauge.operators.positions import newest_per_key, with_position


@pytest.fixture(params=["-1", "10m"])
def threshold(spark, request):
    """Sort-merge joins only, or broadcasts of small sides as well."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield
    spark.conf.set(name, before)


def test_positions_with_a_hot_key(spark, threshold):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 97 == 0, None).otherwise((F.col("id") % 50).cast("string"))
    df = spark.range(20_000, numPartitions=7).select(key.alias("k"), (F.col("id") * 7919 % 20_011).alias("v"))
    got = with_position(df, ["k"], [F.col("v")])
    w = Window.partitionBy("k")
    want = df.select("k", "v", (F.row_number().over(w.orderBy("v")) - 1).cast("long").alias("position"), F.count("*").over(w).alias("total"))
    assert got.count() == 20_000
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_positions_without_key_descending(spark, rows):
    df = spark.range(1000, numPartitions=5)
    got = with_position(df, [], [F.col("id").desc()])
    assert rows(got.filter("position <> 999 - id or total <> 1000")) == []


def test_newest_per_key_trims_before_the_shuffle(spark):
    df = spark.range(10_000, numPartitions=4).select((F.col("id") % 2).alias("k"), "id")
    top = newest_per_key(df, ["k"], [F.col("id").desc()], 3)
    assert {r["id"] for r in top.collect()} == {9999, 9997, 9995, 9998, 9996, 9994}
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_exists_within_against_brute_force(spark):
    rng = random.Random(5)
    base = datetime(2024, 1, 1, tzinfo=timezone.utc)
    lefts = [(i, base + timedelta(seconds=rng.randrange(40 * 86400))) for i in range(400)]
    points = [(base + timedelta(seconds=rng.randrange(40 * 86400)),) for _ in range(25)]
    left = spark.createDataFrame(lefts, "id long, t timestamp")
    right = spark.createDataFrame(points, "p timestamp")
    got = {r["id"]: r["hit"] for r in exists_within(left, F.col("t"), right, F.col("p"), 1, 25, "hit").collect()}
    lo, hi = timedelta(hours=1), timedelta(hours=25)
    assert got == {i: any(t - lo < p < t + hi for (p,) in points) for i, t in lefts}
    assert len(set(got.values())) == 2


def _vectors(spark, n, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, 8)))]
    return rows, spark.createDataFrame(rows, "id long, vector array<double>")


def _score(x, y):
    x, y = np.array(x), np.array(y)
    return (x @ y / np.linalg.norm(x) / np.linalg.norm(y) + 1) / 2


@pytest.mark.parametrize("k, shard, strip", [(1, 8192, 512), (1, 5, 7), (6, 5, 7), (200, 16, 512)])
def test_nearest_equals_brute_force(spark, monkeypatch, k, shard, strip):
    monkeypatch.setattr(similarity, "SHARD_ROWS", shard)
    monkeypatch.setattr(similarity, "STRIP", strip)
    a, left = _vectors(spark, 23, 1)
    b, right = _vectors(spark, 90, 2)
    b, right = b + [(i + 500, v) for i, v in b[:40]], right.union(right.filter("id < 40").withColumn("id", F.col("id") + 500))  # ties
    found = similarity.nearest(left, right, k).collect()
    for i, x in a:
        want = sorted(((-round(_score(x, y), 9), j) for j, y in b))[:k]
        got = sorted((r["rank"], r["right_id"], round(r["score"], 9)) for r in found if r["left_id"] == i)
        assert [(-s, j) for _, j, s in got] == want and [r for r, _, _ in got] == list(range(1, len(want) + 1))


def test_nearest_skips_far_cells_and_takes_text_ids(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    rows = [(f"{i:05d}-{'ab'[i % 2]}", [float(x) for x in centres[i % 30] + rng.normal(size=16) / 50]) for i in range(1500)]
    right = spark.createDataFrame(rows, "id string, vector array<double>")
    left = spark.createDataFrame([(f"t{i}", [float(x) for x in c]) for i, c in enumerate(centres)], "id string, vector array<double>")
    grid = similarity.Grid(similarity._usable(right))
    found = similarity.nearest(left, right, 3).collect()
    for i, c in enumerate(centres):
        want = sorted(((-round(_score(c, y), 9), j) for j, y in rows))[:3]
        assert [(-round(r["score"], 9), r["right_id"]) for r in sorted(found, key=lambda r: r["rank"]) if r["left_id"] == f"t{i}"] == want
    least = {r["left_id"]: r["score"] for r in found if r["rank"] == 3}
    bounded = spark.createDataFrame([(f"t{i}", [float(x) for x in c], least[f"t{i}"]) for i, c in enumerate(centres)], "id string, vector array<double>, threshold double")
    met = similarity.visits(bounded, grid, 3, True).groupBy("id").count().agg(F.sum("count")).collect()[0][0] or 0
    assert met < 0.2 * len(grid.cells) * len(centres)  # most cells are never met


def test_ties_go_to_the_first_and_odd_vectors_never_win(spark, rows):
    nan, inf = float("nan"), float("inf")
    left = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0])], "id long, vector array<double>")
    odd = [(1, [nan, 1.0]), (2, [inf, 0.0]), (3, None), (7, [1.0, None])]
    right = spark.createDataFrame([(9, [2.0, 0.0]), (4, [3.0, 0.0]), (5, [0.0, 0.0]), (6, [0.0, 1.0]), *odd], "id long, vector array<double>")
    assert rows(similarity.top1(left, right)) == [(1, 4, 1.0)]
    assert rows(similarity.nearest(left, right, 3), "right_id", "rank") == [(4, 1), (6, 3), (9, 2)]
    assert rows(similarity.top1(left, right.limit(0))) == [] and rows(similarity.top1(left.limit(0), right)) == []
    opposite = spark.createDataFrame([(1, [-1.0, 0.0])], "id long, vector array<double>")
    assert rows(similarity.top1(left, opposite)) == []
    pairs = spark.createDataFrame([(1, 6), (1, 5), (1, 4), (9, 9)], "left_id long, right_id long")
    assert rows(similarity.pair_scores(pairs, left, right)) == [(1, 4, 1.0), (1, 5, None), (1, 6, 0.5)]


@pytest.mark.parametrize("pack, shard", [(256, 8192), (3, 7)])
def test_every_pair_is_scored_and_ranked(spark, monkeypatch, pack, shard):
    monkeypatch.setattr(similarity, "PACK_ROWS", pack)
    monkeypatch.setattr(similarity, "SHARD_ROWS", shard)
    a, left = _vectors(spark, 9, 1)
    b, right = _vectors(spark, 40, 2)
    right = right.union(spark.createDataFrame([(3, b[5][1]), (90, None), (91, [0.0] * 8)], right.schema))  # an id twice, no score
    b = [*b, (3, b[5][1])]
    want = sorted((i, j, round(_score(x, y), 9)) for i, x in a for j, y in b)
    got = [(r["left_id"], r["right_id"], r["score"] and round(r["score"], 9)) for r in similarity.pair_scores(None, left, right).collect()]
    assert sorted(r for r in got if r[2] is not None) == want
    assert sorted(r[:2] for r in got if r[2] is None) == [(i, j) for i, _ in a for j in (90, 91)]
    ranks = sorted(tuple(r) for r in matching.rank_matches(left, right).select("taxonomy_id", "rank", "content_id").collect())
    for i, _ in a:
        own = [j for s, j in sorted((-s, j) for k, j, s in want if k == i)] + [90, 91]
        assert [r for r in ranks if r[0] == i] == [(i, n + 1, j) for n, j in enumerate(own)]


def test_retention_spares_the_newest(spark, rows):
    refs = spark.createDataFrame(
        [(i, c, i * 10, 100 + i) for c, ids in (("dom", range(6)), ("console", range(10, 12))) for i in ids],
        "id long, category string, ts_ms long, size long",
    )
    gone = artifacts.retention_cleanup(refs, older_than_ms=1000, keep_last=2)
    assert rows(gone, "id") == [(0,), (1,), (2,), (3,)]
    assert rows(artifacts.retention_stats(gone)) == [("dom", 4, 406)]
    assert artifacts.retention_cleanup(refs, older_than_ms=50).count() == 5


@pytest.mark.parametrize("keep", [1, 2, 5, 9, 50])
def test_retention_with_null_categories_and_ties(spark, keep):
    times = [None, 5, 5, 5, 61_000, 61_000, 61_001, 200_000, 200_000, None]
    data = [(i, c, times[(i * 7) % 10]) for i, c in enumerate([None, "dom", None, "dom", "dom"] * 6)]
    refs = spark.createDataFrame(data, "id long, category string, ts_ms long")
    gone = {r["id"] for r in artifacts.retention_cleanup(refs, keep_last=keep).collect()}
    want = set()
    for c in (None, "dom"):
        own = sorted((r for r in data if r[1] == c), key=lambda r: (-1 if r[2] is None else r[2], r[0]), reverse=True)
        want |= {r[0] for r in own[keep:]}
    assert gone == want


def test_left_join_with_a_hot_right_key(spark, rows):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, name string")
    right = spark.range(100).select(F.when(F.col("id") < 90, 1).otherwise(7).cast("long").alias("k"), "id")
    assert rows(left_join_hot_right(left, right, ["k"])) == rows(left.join(right, ["k"], "left"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_equals_join(spark, rows, threshold, how):
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, None).otherwise(F.col("id") % 40)
    many = spark.range(6000, numPartitions=5).select(key.cast("long").alias("k"), "id", F.lit("x").alias("salt"))
    few = spark.createDataFrame([(i, f"n{i}") for i in range(0, 40, 2)] + [(7, "hot"), (7, "hot too"), (None, "null")], "k long, name string")
    for hot_rows in (10**6, 100):
        got = skew_join(many, few, ["k"], how, hot_rows)
        assert got.columns == ["k", "id", "salt", "name"] and rows(got) == rows(many.join(few, "k", how))
    assert {r["k"]: r["parts"] for r in hot_keys(many.filter("k is not null"), ["k"], 100).collect()} == {7: 21}


def test_skew_join_spreads_a_hot_key(spark):
    """A third of the rows on one key and a third without: no task has more than three times the median."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, None).otherwise(F.col("id") % 5000 + 100)
    many = spark.range(60_000, numPartitions=6).select(key.cast("long").alias("k"), "id")
    few = spark.range(6000).select(F.col("id").alias("k"), F.lit("n").alias("name"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "12"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        sizes = skew_join(many, few, ["k"], "inner", 200).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    sizes = sorted(r["count"] for r in sizes)
    assert sum(sizes) == 40_000 and sizes[-1] <= 3 * sizes[len(sizes) // 2]


def _halves(data):
    """(n, a, b) per key from (key, date, id, value) rows."""
    out = {}
    for key in {r[0] for r in data}:
        own = sorted((r for r in data if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        mean = lambda x: sum(x) / len(x) if x else None
        cut = len(own) // 2
        out[key] = (len(own), *(mean([r[3] for r in side if r[3] is not None]) for side in (own[:cut], own[cut:])))
    return out


def test_halves_by_refined_histograms(spark, threshold):
    rng = random.Random(8)
    base = datetime(2020, 1, 1, tzinfo=timezone.utc)
    data = []
    for i in range(1500):
        key = rng.choice(["a", "a", "a", "b", None, f"k{i % 40}"])
        when = base + timedelta(days=rng.choice([0, 1, 1, 1, 700]), microseconds=rng.choice([0, 0, 5, 4000, 9_000_000_000]))
        data.append((key, None if i % 50 == 0 else when, f"id-{i:05d}", None if i % 13 == 0 else float(rng.randrange(100))))
    df = spark.createDataFrame(data, "k string, date timestamp, id string, value double")
    got = {r["k"]: (r["n"], r["a"], r["b"]) for r in halves(df, ["k"]).collect()}
    want = _halves([(k, d and d.timestamp(), i, v) for k, d, i, v in data])
    assert got.keys() == want.keys()
    for key, means in want.items():
        assert [x and pytest.approx(x, rel=1e-12) for x in means] == list(got[key])
    alone = halves(df.drop("k")).collect()
    whole = _halves([(1, d and d.timestamp(), i, v) for _, d, i, v in data])[1]
    assert tuple(alone[0]) == pytest.approx(whole, rel=1e-12)
    assert halves(df.limit(0), ["k"]).collect() == [] and halves(df.limit(0)).collect() == []


def test_halves_sort_no_whole_input(spark):
    df = spark.range(1000).selectExpr("id % 3 k", "timestamp_seconds(id) date", "string(id) id", "double(id) value")
    plan = halves(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Scan ExistingRDD" not in plan


def test_percentiles_by_bins(spark, threshold):
    rng = np.random.default_rng(6)
    data = [("big", float(x)) for x in rng.pareto(0.5, 3000)] + [("one", 4.5), ("none", None), ("two", 1.0), ("two", 2.0)]
    data += [("same", 7.0)] * 40 + [(None, float(x)) for x in rng.integers(0, 4, 99)] + [("wide", x) for x in (-1e300, 0.0, 1e-300, 1e300)]
    df = spark.createDataFrame(data, "k string, v double")
    shares = {"low": 0.0, "median": 0.5, "p90": 0.9, "high": 1.0}
    got = {r["k"]: tuple(r)[1:] for r in percentiles(df, ["k"], F.col("v"), shares).collect()}
    for key in {k for k, _ in data}:
        own = [v for k, v in data if k == key and v is not None]
        want = np.quantile(own, list(shares.values())) if own else [0.0] * 4
        assert got[key] == pytest.approx(tuple(want), rel=1e-12)
    alone = percentiles(df, [], F.col("v"), {"median": 0.5}).collect()
    assert alone[0][0] == pytest.approx(np.median([v for _, v in data if v is not None]))
    assert [tuple(r) for r in percentiles(df.limit(0), [], F.col("v"), {"median": 0.5}).collect()] == [(0.0,)]
