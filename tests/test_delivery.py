"""Literal cases of the delivery metrics."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sparkgauge.functions import levels
from sparkgauge.functions.timefns import diff_hours, round2
from sparkgauge.operators import delivery as d
from sparkgauge.operators.trends import trend, weekly_series

UTC = timezone.utc
PR = "id long, number long, state string, created_at timestamp, merged_at timestamp, first_commit_at timestamp, repo string, labels array<string>"
DEP = "id string, environment string, status string, created_at timestamp, completed_at timestamp, repo string, pr_number long"
INC = (
    "id long, created timestamp, resolved timestamp, is_incident boolean, incident_start timestamp, "
    "incident_resolution timestamp, labels array<string>, feature_key string"
)
START, END = datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 1, 31, tzinfo=UTC)


def at(day, hour=0, minute=0):
    return datetime(2024, 1, day, hour, minute, tzinfo=UTC)


def pr(i, created, merged, first=None, repo="a", labels=()):
    return (i, i, "closed", created, merged, first, repo, list(labels))


def dep(i, status="success", created=None, completed=None, env="production", repo="a", number=None):
    return (str(i), env, status, created or at(15, 15), completed, repo, number)


def inc(i, start, end=None, real=True, labels=(), feature=None):
    return (i, start, end, real, start, end, list(labels), feature)


def frames(spark, prs=(), deps=(), incs=()):
    make = spark.createDataFrame
    return make(list(prs), PR), make(list(deps), DEP), make(list(incs), INC)


def test_lead_time_median_of_6_and_12_hours(spark):
    prs, deps, _ = frames(spark, [pr(1, at(15, 10), at(15, 14), at(15, 8)), pr(2, at(16, 10), at(16, 22))], [dep(1)])
    row = d.lead_time(prs, deps).first()
    assert (row["median"], row["level"], row["trend"], row["deploy"]) == (9.0, "elite", "stable", 2.0)


def test_lead_time_phases(spark):
    prs, deps, _ = frames(spark, [pr(1, at(15, 10), at(15, 14), at(15, 8))])
    row = d.lead_time(prs, deps).first()
    assert (row["coding"], row["review"], row["pickup"], row["deploy"]) == (2.0, 4.0, 0.0, 0.0)


def test_lead_time_without_first_commit_starts_at_creation(spark):
    prs, deps, _ = frames(spark, [pr(1, at(15, 10), at(15, 14))])
    assert d.lead_time(prs, deps).first()["median"] == 4.0


def test_unmerged_and_negative_lead_times_do_not_count(spark):
    prs, deps, _ = frames(spark, [pr(1, at(15, 10), None), pr(2, at(15, 10), at(14, 10)), pr(3, at(1), at(2))])
    assert d.lead_time(prs, deps).first()["median"] == 24.0


def test_failure_rate_three_good_one_bad(spark):
    _, deps, incs = frames(spark, deps=[dep(1), dep(2), dep(3), dep(4, "failure")])
    row = d.change_failure_rate(deps, incs).first()
    assert (row["rate"], row["total_deployments"], row["failed_deployments"], row["level"]) == (25.0, 4, 1, "low")


def test_incident_30_minutes_after_completion_fails_the_deployment(spark):
    _, deps, incs = frames(spark, deps=[dep(1, completed=at(15, 15, 30))], incs=[inc(1, at(15, 16), at(15, 18))])
    assert d.change_failure_rate(deps, incs).first()["rate"] == 100.0


@pytest.mark.parametrize("minutes, hit", [(-61, False), (-60, False), (-59, True), (0, True), (1499, True), (1500, False)])
def test_incident_window_edges(spark, minutes, hit):
    done = at(15, 15, 20)
    _, deps, incs = frames(spark, deps=[dep(1, completed=done)], incs=[inc(1, done + timedelta(minutes=minutes))])
    assert d.incident_within_24h(deps, incs).first()["failed"] is hit


def test_recovery_skips_open_and_unreal_incidents(spark):
    _, _, incs = frames(spark, incs=[inc(1, at(15, 16), at(15, 18)), inc(2, at(15, 16)), inc(3, at(1), at(9), real=False)])
    row = d.recovery_time(incs).first()
    assert (row["median"], row["level"], row["incidents"]) == (2.0, "high", 2)


def test_frequency_of_a_public_repository_week(spark):
    deps = [dep(i, "success" if i else "failure", created=at(10, i)) for i in range(9)]
    prs, deps, incs = frames(spark, [], deps)
    row = d.delivery_metrics(prs, deps, incs, at(5), at(12)).first()
    assert (row["frequency_value"], row["frequency_unit"], row["failure_rate"]) == (1.14, "day", 11.11)
    assert row["failure_level"] == row["overall_level"] == "medium"


def test_empty_input_is_zero_and_low(spark):
    row = d.delivery_metrics(*frames(spark), START, END).first()
    assert (row["frequency_value"], row["lead_median"], row["failure_rate"], row["recovery_median"]) == (0, 0, 0, 0)
    assert (row["frequency_level"], row["overall_level"], row["lead_trend"]) == ("low", "low", "stable")


def test_group_known_to_one_input_only(spark):
    prs, deps, incs = frames(spark, [pr(1, at(1), at(2), repo="x")], [dep(1, repo="y")])
    incs = incs.withColumn("repo", F.lit("z"))
    found = {r["repo"]: r for r in d.delivery_metrics(prs, deps, incs, START, END, ["repo"]).collect()}
    assert found["x"]["lead_median"] == 24.0 and found["x"]["frequency_value"] == 0
    assert found["y"]["lead_median"] == 0 and found["y"]["frequency_unit"] == "month"


def test_levels_at_their_limits(spark):
    df = spark.createDataFrame([(1.0, 24.0, 5.0, 1.0), (1 / 7, 168.0, 10.0, 24.0), (1 / 30, 720.0, 15.0, 168.0), (0.01, 721.0, 15.1, 169.0)], "f double, l double, c double, r double")
    got = df.select(
        levels.level_frequency(F.col("f")), levels.level_lead_time(F.col("l")), levels.level_failure_rate(F.col("c")), levels.level_recovery(F.col("r"))
    ).collect()
    assert [set(r) for r in got] == [{"elite"}, {"high"}, {"medium"}, {"low"}]


@pytest.mark.parametrize(
    "values, lower, want",
    [
        ([1, 1, 1], True, "stable"),
        ([10, 10, 10.5, 10.5], True, "stable"),
        ([10, 10, 5, 5], True, "improving"),
        ([10, 10, 5, 5], False, "declining"),
        ([0, 0, 3, 3], False, "improving"),
        ([4, 4, 4, 9, 9], True, "declining"),
    ],
)
def test_trend(spark, values, lower, want):
    points = [(at(i + 1), i, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(points[::-1], "date timestamp, id long, value double")
    assert trend(df, lower_is_better=lower).first()["trend"] == want


def test_weekly_series_fills_empty_weeks(spark):
    df = spark.createDataFrame([(at(6), 2.0), (at(7), 4.0), (at(23), 8.0)], "date timestamp, value double")
    got = [(str(r["week"]), r["value"], r["n"]) for r in weekly_series(df).orderBy("week").collect()]
    assert got == [("2023-12-31", 2.0, 1), ("2024-01-07", 4.0, 1), ("2024-01-14", 0.0, 0), ("2024-01-21", 8.0, 1)]


def test_truncation_and_rounding(spark):
    df = spark.createDataFrame([(at(2), at(2, 0, 30)), (at(2, 1, 59), at(2))], "a timestamp, b timestamp")
    assert [r[0] for r in df.select(diff_hours(F.col("a"), F.col("b"))).collect()] == [0, 1]
    assert spark.range(1).select(round2(F.lit(1.005)), round2(F.lit(2.675000001))).first()[1] == 2.68


def test_fallback_deployments_only_when_there_are_none(spark, rows):
    prs, deps, _ = frames(spark, [pr(7, at(1), at(2)), pr(8, at(1), None)], [dep(1)])
    assert rows(d.deployments_or_fallback(deps.filter("false"), prs), "id", "status") == [("pr-7", "success")]
    assert rows(d.deployments_or_fallback(deps, prs), "id") == [("1",)]


def test_feature_filter(spark, rows):
    prs, deps, incs = frames(
        spark,
        [pr(1, at(1), at(2), labels=["Team-Login"]), pr(2, at(1), at(2), labels=["x"])],
        [dep(1, number=1), dep(2, number=2)],
        [inc(1, at(1), feature="LOGIN-1"), inc(2, at(1), labels=["login page"]), inc(3, at(1))],
    )
    p, dd, i = d.filter_by_feature(prs, deps, incs, ["login"])
    assert (rows(p, "id"), rows(dd, "id"), rows(i, "id")) == ([(1,)], [("1",)], [(1,), (2,)])


def test_latest_status(spark, rows):
    deps = spark.createDataFrame([(1, at(2)), (2, at(3)), (3, at(30) + timedelta(days=9))], "id long, created_at timestamp")
    statuses = spark.createDataFrame(
        [(1, 1, at(4), "pending"), (1, 2, at(4), "success"), (1, 3, at(3), "failure")],
        "deployment_id long, status_id long, status_at timestamp, state string",
    )
    got = d.deployments_latest_status(deps, statuses, START, END)
    assert rows(got, "id", "status") == [(1, "success"), (2, "pending")]
