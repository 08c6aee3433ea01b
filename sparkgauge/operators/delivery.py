"""Delivery-performance metrics over pull requests, deployments and incidents.

Every metric takes ``by``, a list of grouping columns; without it the result is one row.
Durations are whole hours, so exact percentiles come from counts of a bounded set of
distinct values; trends come from refined histograms of the dates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgauge.functions.levels import (
    level_failure_rate,
    level_frequency,
    level_lead_time,
    level_recovery,
    overall_level,
)
from sparkgauge.functions.timefns import diff_hours, diff_ms, round2
from sparkgauge.operators.intervals import exists_within
from sparkgauge.operators.order_stats import counted_percentiles, halves, percentiles, time_bucket
from sparkgauge.operators.trends import direction
from sparkgauge.session import scratch_path

DEPLOY_DELAY_HOURS = 2.0  # fixed value: assumed merge-to-deploy delay
METRICS = ("lead", "failure", "recovery")  # those with a trend


def _is_prod() -> Column:
    return F.lower("environment").contains("prod")


def _start() -> Column:
    return F.coalesce("incident_start", "created")


def percentile_linear(df: DataFrame, keys: Sequence[str], value: Column, shares: Mapping[str, float]) -> DataFrame:
    """(keys, one column per share) with linear interpolation; 0 when a group has no value."""
    return percentiles(df, keys, value, shares)


def mean_or_zero(value: Column) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def deployment_points(deployments: DataFrame) -> DataFrame:
    """(date, 1) per successful production deployment."""
    kept = deployments.filter((F.col("status") == "success") & _is_prod())
    return kept.withColumn("date", F.col("created_at")).withColumn("value", F.lit(1.0))


def lead_time_points(prs: DataFrame) -> DataFrame:
    """(merge date, fractional hours from creation to merge) where both exist."""
    hours = diff_ms(F.col("merged_at"), F.col("created_at")) / 3_600_000
    kept = prs.filter(F.col("merged_at").isNotNull() & F.col("created_at").isNotNull())
    return kept.withColumn("date", F.col("merged_at")).withColumn("value", hours)


def deployment_frequency(
    deployments: DataFrame, start: datetime, end: datetime, by: Sequence[str] = ()
) -> DataFrame:
    """Successful production deployments per day, shown per day, week or month.

    The trend of a constant series is always ``stable``, so it costs no pass.
    """
    n = F.count_if((F.col("status") == "success") & _is_prod())
    counted = deployments.groupBy(*by).agg(n.alias("deployments"))
    per_day = F.col("deployments") / F.lit(_whole_days(start, end))
    value, unit = _shown_frequency(per_day)
    return counted.select(
        *by,
        "deployments",
        value.alias("value"),
        unit.alias("unit"),
        level_frequency(per_day).alias("level"),
        F.lit("stable").alias("trend"),
    )


def _whole_days(start: datetime, end: datetime) -> int:
    return max(int((end - start).total_seconds() // 86400), 0) or 1


def _shown_frequency(per_day: Column) -> tuple[Column, Column]:
    """Rounded value and unit: per day, per week or per month of 30 days."""
    daily, weekly = per_day >= 1, per_day >= 1 / 7
    value = F.when(daily, per_day).when(weekly, per_day * 7).otherwise(per_day * 30)
    return round2(value), F.when(daily, "day").when(weekly, "week").otherwise("month")


def with_lead_hours(prs: DataFrame) -> DataFrame:
    """Add total, coding and review hours of merged pull requests; null unless positive."""
    first = F.coalesce("first_commit_at", "created_at")
    spans = {
        "total_hours": diff_hours(F.col("merged_at"), first),
        "coding_hours": F.when(F.col("merged_at").isNotNull(), diff_hours(F.col("created_at"), first)),
        "review_hours": diff_hours(F.col("merged_at"), F.col("created_at")),
    }
    for name, hours in spans.items():
        prs = prs.withColumn(name, F.when(hours > 0, hours))
    return prs


def incident_within_24h(deployments: DataFrame, incidents: DataFrame) -> DataFrame:
    """Production deployments with ``failed``: own failure, or any incident that starts
    0 to 24 whole hours after completion (else creation). Truncation toward zero makes
    the open window (-1 h, +25 h)."""
    prod = deployments.filter(_is_prod())
    done = F.coalesce("completed_at", "created_at")
    marked = exists_within(prod, done, incidents, _start(), 1, 25, "_hit")
    return marked.withColumn("failed", (F.col("status") == "failure") | F.col("_hit")).drop("_hit")


# ---- facts: one row per pull request, deployment or incident, labelled with its metric.
# ``value`` is the trended measure; rows without one still count in the totals.


def _fact(df: DataFrame, metric: str, by: Sequence[str], date: Column, value: Column, **more: Column) -> DataFrame:
    return df.select(
        *by,
        F.lit(metric).alias("metric"),
        date.alias("date"),
        F.col("id").cast("string").alias("id"),
        value.cast("double").alias("value"),
        *[c.alias(n) for n, c in more.items()],
    )


def _lead_facts(prs: DataFrame, by: Sequence[str]) -> DataFrame:
    spans = with_lead_hours(prs)
    more = {"coding": F.col("coding_hours"), "review": F.col("review_hours")}
    return _fact(spans, "lead", by, F.col("merged_at"), F.col("total_hours"), **more)


def _failure_facts(deployments: DataFrame, incidents: DataFrame, by: Sequence[str]) -> DataFrame:
    marked = incident_within_24h(deployments, incidents)
    status = F.col("status")
    more = {"failed": F.col("failed"), "succeeded": status == "success"}
    return _fact(marked, "failure", by, F.col("created_at"), (status == "failure").cast("int"), **more)


def _points(facts: DataFrame, by: Sequence[str]) -> DataFrame:
    """What a trend needs of facts."""
    return facts.select("metric", *by, "date", "id", "value")


def _failure_points(deployments: DataFrame, by: Sequence[str]) -> DataFrame:
    """Trended points of the failure rate: status alone, so no incident is looked up."""
    failed = (F.col("status") == "failure").cast("int")
    return _points(_fact(deployments.filter(_is_prod()), "failure", by, F.col("created_at"), failed), by)


def _recovery_facts(incidents: DataFrame, by: Sequence[str]) -> DataFrame:
    hours = diff_hours(F.coalesce("incident_resolution", "resolved"), _start())
    return _fact(incidents.filter("is_incident"), "recovery", by, _start(), F.when(hours >= 0, hours))


def _presence(deployments: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per group that has any deployment."""
    seen = deployments.groupBy(*by).agg(F.count("*").alias("_n")).filter("_n > 0")
    return seen.select(*by, F.lit("deployed").alias("metric"))


def _measure(facts: Sequence[DataFrame], trended: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """All raw measures per group; no row is sorted but those around the middle of a trend.

    One aggregate counts the stacked ``facts``: rows, outcomes, whole hours (a group has a
    bounded number of distinct ones) and time buckets. Totals, percentiles and the first
    step of the trends are read off its small result; ``trended`` (metric, keys, date, id,
    value) is read once more for the rows in the middle. The parts meet in a union, so no
    group is lost.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), facts)
    columns = {"date": "timestamp", "value": "double", "coding": "long", "review": "long", "failed": "boolean", "succeeded": "boolean"}
    for column, kind in columns.items():
        if column not in stacked.columns:
            stacked = stacked.withColumn(column, F.lit(None).cast(kind))
    metric, value = F.col("metric"), F.col("value")

    def entry(test: Column, kind: Column, code: Column, x: Column) -> Column:
        return F.when(test, F.struct(kind.alias("kind"), code.cast("long").alias("code"), x.cast("double").alias("x")))

    zero, nothing, has = F.lit(0), F.lit(None), value.isNotNull()
    entries = [
        entry(F.lit(True), F.concat(F.lit("rows "), metric), zero, nothing),
        entry(F.col("failed"), F.lit("failed"), zero, nothing),
        entry(F.col("succeeded"), F.lit("succeeded"), zero, nothing),
        entry(has & metric.isin("lead", "recovery"), metric, value, nothing),
        entry(F.col("coding").isNotNull(), F.lit("coding"), F.col("coding"), nothing),
        entry(F.col("review").isNotNull(), F.lit("review"), F.col("review"), nothing),
        entry(has & metric.isin(*METRICS), F.concat(F.lit("time "), metric), time_bucket(), value),
    ]
    melted = stacked.select(*by, F.inline(F.array_compact(F.array(*entries))))
    counted = melted.groupBy(*by, "kind", "code").agg(F.count("*").alias("n"), F.sum("x").alias("s"))
    spark = counted.sparkSession
    path = scratch_path(spark, "counts")
    counted.write.parquet(path)
    counts = spark.read.schema(counted.schema).parquet(path)

    def total(kind: str) -> Column:
        return F.sum(F.when(F.col("kind") == kind, F.col("n")))

    def mean(kind: str) -> Column:
        return F.try_divide(F.sum(F.when(F.col("kind") == kind, F.col("code") * F.col("n"))), total(kind))

    sums = [total(f"rows {m}").alias(f"{m}_rows") for m in METRICS] + [mean(m).alias(f"{m}_mean") for m in ("lead", "recovery")]
    sums += [total("failed").alias("failed"), total("succeeded").alias("succeeded"), total("rows deployed").alias("deployments")]
    totals = counts.groupBy(*by).agg(*sums)

    spans = ("lead", "recovery", "coding", "review")
    hours = counts.filter(F.col("kind").isin(*spans)).select(*by, "kind", F.col("code").cast("double").alias("value"), "n")
    ranked = counted_percentiles(hours, [*by, "kind"], {"median": 0.5, "p90": 0.9})
    of = lambda n, c: F.max(F.when(F.col("kind") == n, F.col(c)))
    ranked = ranked.groupBy(*by).agg(*[of(n, c).alias(f"{n}_{c}") for n in spans for c in ("median", "p90")])

    times = counts.filter(F.col("kind").startswith("time ")).select(F.substring("kind", 6, 99).alias("metric"), *by, "code", "n", F.col("n").alias("c"), "s")
    points = reduce(lambda a, b: a.unionByName(b), trended)
    split = halves(points.filter("value is not null"), ["metric", *by], times)
    sides = [F.max(F.when(metric == m, F.col(c))).alias(f"{m}_{c}") for m in METRICS for c in ("n", "a", "b")]
    small = [totals, ranked, split.groupBy(*by).agg(*sides)]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), small)
    names = [c for c in together.columns if c not in by]
    measured = together.groupBy(*by).agg(*[F.max(c).alias(c) for c in names])
    measured = measured.fillna(0, [c for c in names if c[-2:] not in ("_a", "_b")])
    rate = F.coalesce(F.try_divide(F.col("failed"), F.col("failure_rows")) * 100, F.lit(0.0))
    trends = [direction(F.col(f"{m}_n"), F.col(f"{m}_a"), F.col(f"{m}_b"), F.lit(True)).alias(f"{m}_trend") for m in METRICS]
    return measured.select("*", rate.alias("failure_rate"), (F.col("deployments") > 0).alias("deployed"), *trends)


def lead_time(prs: DataFrame, deployments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First commit to merge: median, mean, p90, band, trend and phase medians."""
    leads = _lead_facts(prs, by)
    m = _measure([leads, _presence(deployments, by)], [_points(leads, by)], by)
    both = F.col("deployed") & (F.col("lead_rows") > 0)
    return m.select(
        *by,
        round2(F.col("lead_median")).alias("median"),
        round2(F.col("lead_mean")).alias("mean"),
        round2(F.col("lead_p90")).alias("p90"),
        level_lead_time(F.col("lead_median")).alias("level"),
        round2(F.col("coding_median")).alias("coding"),
        F.lit(0.0).alias("pickup"),
        round2(F.col("review_median")).alias("review"),
        F.when(both, DEPLOY_DELAY_HOURS).otherwise(0.0).alias("deploy"),
        F.col("lead_trend").alias("trend"),
    )


def change_failure_rate(deployments: DataFrame, incidents: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Failed share of production deployments in percent; the trend looks at status only."""
    m = _measure([_failure_facts(deployments, incidents, by)], [_failure_points(deployments, by)], by)
    return m.select(
        *by,
        round2(F.col("failure_rate")).alias("rate"),
        F.col("failure_rows").alias("total_deployments"),
        F.col("failed").alias("failed_deployments"),
        level_failure_rate(F.col("failure_rate")).alias("level"),
        F.col("failure_trend").alias("trend"),
    )


def recovery_time(incidents: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Start to resolution of real incidents; unresolved and negative ones are skipped."""
    spans = _recovery_facts(incidents, by)
    m = _measure([spans], [_points(spans, by)], by)
    return m.select(
        *by,
        round2(F.col("recovery_median")).alias("median"),
        round2(F.col("recovery_mean")).alias("mean"),
        round2(F.col("recovery_p90")).alias("p90"),
        level_recovery(F.col("recovery_median")).alias("level"),
        F.col("recovery_rows").alias("incidents"),
        F.col("recovery_trend").alias("trend"),
    )


def delivery_metrics(
    prs: DataFrame,
    deployments: DataFrame,
    incidents: DataFrame,
    start: datetime,
    end: datetime,
    by: Sequence[str] = (),
) -> DataFrame:
    """All four metrics and the worst band from one pass over each input; no join between
    metrics. A group missing from one input keeps that metric at 0."""
    leads, spans = _lead_facts(prs, by), _recovery_facts(incidents, by)
    facts = [leads, _failure_facts(deployments, incidents, by), spans, _presence(deployments, by)]
    m = _measure(facts, [_points(leads, by), _failure_points(deployments, by), _points(spans, by)], by)
    per_day = F.col("succeeded") / F.lit(_whole_days(start, end))
    value, unit = _shown_frequency(per_day)
    out = m.select(
        *by,
        value.alias("frequency_value"),
        unit.alias("frequency_unit"),
        level_frequency(per_day).alias("frequency_level"),
        round2(F.col("lead_median")).alias("lead_median"),
        round2(F.col("lead_p90")).alias("lead_p90"),
        level_lead_time(F.col("lead_median")).alias("lead_level"),
        "lead_trend",
        round2(F.col("failure_rate")).alias("failure_rate"),
        level_failure_rate(F.col("failure_rate")).alias("failure_level"),
        "failure_trend",
        round2(F.col("recovery_median")).alias("recovery_median"),
        level_recovery(F.col("recovery_median")).alias("recovery_level"),
        "recovery_trend",
    )
    levels = [F.col(f"{name}_level") for name in ("frequency", "lead", "failure", "recovery")]
    return out.withColumn("overall_level", overall_level(*levels))


# ---- source-side shaping


def merged_prs(prs: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Closed and merged inside the period; first commit falls back to creation."""
    kept = prs.filter((F.col("state") == "closed") & F.col("merged_at").between(start, end))
    return kept.withColumn("first_commit_at", F.col("created_at")).withColumn(
        "author", F.coalesce("author", F.lit("unknown"))
    )


def deployments_latest_status(
    deployments: DataFrame, statuses: DataFrame, start: datetime, end: datetime, environment: str | None = None
) -> DataFrame:
    """Newest status per deployment of the period, of one environment or of all; no status
    means ``pending``, no environment or an empty one ``unknown``."""
    if "environment" not in deployments.columns:
        deployments = deployments.withColumn("environment", F.lit(None).cast("string"))
    latest = statuses.groupBy("deployment_id").agg(
        F.max(F.struct("status_at", "status_id", "state")).alias("_s")
    )
    kept = deployments.filter(F.col("created_at").between(start, end))
    if environment is not None:
        kept = kept.filter(F.col("environment") == environment)
    own = [c for c in kept.columns if c != "environment"]
    return kept.join(latest, kept.id == latest.deployment_id, "left").select(
        *own,
        F.coalesce(F.nullif("environment", F.lit("")), F.lit("unknown")).alias("environment"),
        F.coalesce("_s.state", F.lit("pending")).alias("status"),
        F.col("_s.status_at").alias("completed_at"),
    )


def workflow_runs_filter(runs: DataFrame, start: datetime, end: datetime, file: str | None = None) -> DataFrame:
    kept = runs.filter(F.col("created_at").between(start, end))
    return kept.filter(F.col("path").contains(file)) if file else kept


def runs_to_deployments(runs: DataFrame, words: Sequence[str] = ("deploy", "release", "prod")) -> DataFrame:
    """Runs whose name holds one of the words become production deployments."""
    named = reduce(lambda a, b: a | b, [F.lower("name").contains(w.lower()) for w in words])
    done = F.col("conclusion").isin("success", "failure")
    return runs.filter(named).select(
        F.col("id").cast("string").alias("id"),
        F.lit("production").alias("environment"),
        F.when(done, F.col("conclusion")).otherwise("pending").alias("status"),
        "created_at",
        F.col("updated_at").alias("completed_at"),
        "repo",
        F.col("head_sha").alias("sha"),
    )


def deployments_or_fallback(deployments: DataFrame, prs: DataFrame) -> DataFrame:
    """The deployments; when there are none at all, one success per merged pull request."""
    none = deployments.limit(1).select(F.count("*") == 0).scalar()
    made = prs.filter(F.col("merged_at").isNotNull() & none).select(
        F.concat(F.lit("pr-"), F.col("number")).alias("id"),
        F.lit("production").alias("environment"),
        F.lit("success").alias("status"),
        F.col("merged_at").alias("created_at"),
        F.col("merged_at").alias("completed_at"),
        "repo",
        F.col("number").alias("pr_number"),
    )
    return deployments.unionByName(made, allowMissingColumns=True)


# ---- slices and small rollups


def _any_label(labels: str, wanted: Sequence[str]) -> Column:
    words = [w.lower() for w in wanted]
    return F.exists(labels, lambda x: reduce(lambda a, b: a | b, [F.lower(x).contains(w) for w in words]))


def deployments_of_prs(deployments: DataFrame, prs: DataFrame) -> DataFrame:
    return deployments.join(prs.select(F.col("number").alias("pr_number")), "pr_number", "left_semi")


def filter_by_feature(
    prs: DataFrame, deployments: DataFrame, incidents: DataFrame, labels: Sequence[str]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Slice by feature label; incidents also match on their feature key."""
    kept = prs.filter(_any_label("labels", labels))
    key_hit = reduce(lambda a, b: a | b, [F.lower("feature_key").contains(w.lower()) for w in labels])
    return (
        kept,
        deployments_of_prs(deployments, kept),
        incidents.filter(_any_label("labels", labels) | F.coalesce(key_hit, F.lit(False))),
    )


def delivery_slice(
    prs: DataFrame,
    deployments: DataFrame,
    incidents: DataFrame,
    start: datetime,
    end: datetime,
    repo: str | None = None,
    labels: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Period, then repository (not for incidents), then feature."""
    prs = prs.filter(F.col("merged_at").between(start, end))
    deployments = deployments.filter(F.col("created_at").between(start, end))
    incidents = incidents.filter(F.col("created").between(start, end))
    if repo:
        prs = prs.filter(F.col("repo") == repo)
        deployments = deployments.filter(F.col("repo") == repo)
    if labels:
        return filter_by_feature(prs, deployments, incidents, labels)
    return prs, deployments, incidents


def slice_counts(
    prs: DataFrame,
    deployments: DataFrame,
    incidents: DataFrame,
    features: DataFrame,
    start: datetime,
    end: datetime,
) -> DataFrame:
    """Sizes of a slice as one row: per-kind counts stack up and one aggregate folds them."""
    days = -(-int((end - start).total_seconds() * 1000) // 86_400_000)
    inputs = {"pr": prs, "dep": deployments, "inc": incidents, "feature": features}
    kinds = []
    for kind, df in inputs.items():
        repo = F.col("repo") if kind in ("pr", "dep") else F.lit(None).cast("string")
        kinds.append(df.groupBy(F.lit(kind).alias("kind"), repo.alias("repo")).agg(F.count("*").alias("n")))
    rows = reduce(lambda a, b: a.unionByName(b), kinds)

    def total(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))

    return rows.agg(
        total("pr").alias("prs"),
        total("dep").alias("deployments"),
        total("inc").alias("incidents"),
        F.count_distinct("repo").alias("repos"),
        total("feature").alias("features"),
        F.lit(days).cast("long").alias("days"),
    )


def feature_labels(prs: DataFrame, min_count: int = 2, limit: int = 10) -> DataFrame:
    """Labels used at least twice, the first ten by first use."""
    used = prs.select("id", F.posexplode("labels").alias("pos", "label"))
    counted = used.groupBy("label").agg(F.count("*").alias("n"), F.min(F.struct("id", "pos")).alias("_first"))
    return counted.filter(F.col("n") >= min_count).orderBy("_first").limit(limit).select("label", "n")


def lead_time_shares(metric: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of the four phases in percent; 25 each when all are zero."""
    phases = ["coding", "pickup", "review", "deploy"]
    whole = reduce(lambda a, b: a + b, [F.col(p) for p in phases])
    share = [
        F.struct(
            F.lit(p).alias("phase"),
            F.col(p).alias("hours"),
            round2(F.when(whole == 0, 25.0).otherwise(F.try_divide(F.col(p), whole) * 100)).alias("percent"),
        )
        for p in phases
    ]
    return metric.select(*by, F.inline(F.array(*share)))


def repo_comparison(prs: DataFrame, runs: DataFrame) -> DataFrame:
    """Pull-request and run counts per repository, from one stacked aggregate."""
    stacked = prs.select("repo", F.lit(1).alias("p"), F.lit(0).alias("r")).unionByName(
        runs.select("repo", F.lit(0).alias("p"), F.lit(1).alias("r"))
    )
    return stacked.groupBy("repo").agg(F.sum("p").alias("pr_count"), F.sum("r").alias("run_count"))


# ---- issues


def classify_incident(issue_type: Column, labels: Column) -> Column:
    """Type or any label names an incident (fixed word lists)."""
    by_type = F.lower(issue_type).rlike("bug|incident|outage|hotfix|defect")
    by_label = F.exists(labels, lambda x: F.lower(x).rlike("incident|outage|production-issue|p0|p1|critical"))
    return F.coalesce(by_type, F.lit(False)) | F.coalesce(by_label, F.lit(False))


def _midnight(moment: datetime) -> datetime:
    return moment.replace(hour=0, minute=0, second=0, microsecond=0)


def incidents_in_period(
    issues: DataFrame, project: str, start: datetime, end: datetime, types: Sequence[str]
) -> DataFrame:
    kept = issues.filter(
        (F.col("project_key") == project)
        & F.col("issue_type").isin(*types)
        & (F.col("created") >= _midnight(start))
        & (F.col("created") < _midnight(end) + timedelta(days=1))
    )
    kept = kept.withColumn("is_incident", classify_incident(F.col("issue_type"), F.col("labels")))
    return kept.filter("is_incident").orderBy(F.col("created").desc())


def incident_issues(
    issues: DataFrame, end: datetime, labels: Sequence[str] = ("bug", "incident", "outage", "hotfix")
) -> DataFrame:
    """Tracker issues with one of the labels, no pull requests, created by the end, once per id.

    The lower bound of the reference is the API's `since` on the update time; pass a
    frame already filtered on it when it matters.
    """
    wanted = F.array(*[F.lit(x) for x in labels])
    kept = issues.filter(F.arrays_overlap("labels", wanted) & ~F.col("is_pull_request") & (F.col("created") <= end))
    return kept.dropDuplicates(["id"])


def issues_by_epic(issues: DataFrame, epic: str) -> DataFrame:
    return issues.filter(F.col("epic") == epic).orderBy(F.col("created").desc())


def issues_by_label(issues: DataFrame, project: str, label: str, start: datetime, end: datetime) -> DataFrame:
    return issues.filter(
        (F.col("project_key") == project)
        & F.array_contains("labels", label)
        & F.col("created").between(start, end)
    )


def issues_to_incidents(issues: DataFrame, project: str) -> DataFrame:
    """Tracker issue to incident row."""
    return issues.select(
        "id",
        F.concat(F.lit(project + "-"), F.col("number")).alias("key"),
        F.col("title").alias("summary"),
        F.lit("Bug").alias("issue_type"),
        F.when(F.col("state") == "closed", "Done").otherwise("In Progress").alias("status"),
        F.when(F.array_contains("labels", "critical"), "Critical").otherwise("Medium").alias("priority"),
        "created",
        F.coalesce("closed", "created").alias("updated"),
        F.col("closed").alias("resolved"),
        "labels",
        F.lit(True).alias("is_incident"),
        F.col("created").alias("incident_start"),
        F.col("closed").alias("incident_resolution"),
    )


ISSUE_JSON = (
    "id string, key string, fields struct<summary:string, issuetype:struct<name:string>, status:struct<name:string,"
    "statusCategory:struct<key:string>>, priority:struct<name:string>, created:timestamp, updated:timestamp,"
    "resolutiondate:timestamp, labels:array<string>, components:array<struct<name:string>>,"
    "project:struct<key:string,name:string,id:string>, assignee:struct<displayName:string,accountId:string>,"
    "reporter:struct<displayName:string,accountId:string>, parent:struct<key:string>, description:string,"
    "customfield_10104:string, customfield_10016:double>"
)


def normalize_issue(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Nested issue JSON text to flat issue rows; missing lists become empty."""
    issue = raw.select(F.from_json(column, ISSUE_JSON).alias("i")).select("i.*")
    f = "fields."
    empty = F.array().cast("array<string>")
    labels = F.coalesce(F.col(f + "labels"), empty)
    flat = issue.select(
        "id",
        "key",
        F.col(f + "summary").alias("summary"),
        F.col(f + "issuetype.name").alias("issue_type"),
        F.col(f + "status.name").alias("status"),
        F.col(f + "priority.name").alias("priority"),
        F.col(f + "created").alias("created"),
        F.col(f + "updated").alias("updated"),
        F.col(f + "resolutiondate").alias("resolved"),
        labels.alias("labels"),
        F.coalesce(F.transform(f + "components", lambda c: c["name"]), empty).alias("components"),
        F.col(f + "project.key").alias("project_key"),
        F.col(f + "assignee.displayName").alias("assignee"),
        F.col(f + "parent.key").alias("epic"),
    )
    return flat.withColumn("is_incident", classify_incident(F.col("issue_type"), F.col("labels")))
