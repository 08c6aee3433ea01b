"""Delivery queries and their oracle texts."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from sparkgauge.functions import levels
from sparkgauge.functions.timefns import diff_days, diff_hours
from sparkgauge.operators import delivery as d
from sparkgauge.operators.trends import trend, weekly_series
from sparkgauge.plans.registry import query
from sparkgauge.sources.tables import spread


def utc(*parts: int) -> datetime:
    return datetime(*parts, tzinfo=timezone.utc)


P0, P1 = utc(1996, 1, 1), utc(2000, 12, 31)
E0, E1 = utc(2024, 1, 5), utc(2024, 1, 25)
IN_P = "BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-12-31'"
IN_E = "BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'"


def ms(name: str):
    return F.unix_millis(name).alias(name)


# SQL pieces
def HOURS(later, earlier):
    return f"CAST(trunc((epoch_ms({later}) - epoch_ms({earlier})) / 3600000.0) AS BIGINT)"


def R2(x):
    return f"floor(({x}) * 100 + 0.5) / 100"


def BAND(x, a, b, c):
    return f"CASE WHEN {x} <= {a} THEN 'elite' WHEN {x} <= {b} THEN 'high' WHEN {x} <= {c} THEN 'medium' ELSE 'low' END"


def FREQ_BAND(x):
    return f"CASE WHEN {x} >= 1 THEN 'elite' WHEN {x} >= 1/7.0 THEN 'high' WHEN {x} >= 1/30.0 THEN 'medium' ELSE 'low' END"


def TREND(points, lower, keys=""):
    """Trend per ``keys`` over a relation (keys, date, id, value)."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    side = ("'improving'", "'declining'") if lower else ("'declining'", "'improving'")
    return f"""
    SELECT {k}CASE WHEN n < 4 OR abs(chg) < 10 THEN 'stable' WHEN chg < 0 THEN {side[0]} ELSE {side[1]} END AS trend
    FROM (SELECT {k}n, (b - a) / CASE WHEN a = 0 OR a IS NULL THEN 1 ELSE a END * 100 AS chg FROM (
      SELECT {k}count(*) AS n, avg(CASE WHEN rn <= floor(tot / 2) THEN value END) AS a,
             avg(CASE WHEN rn > floor(tot / 2) THEN value END) AS b
      FROM (SELECT *, row_number() OVER ({part}ORDER BY date, id) AS rn,
                   count(*) OVER ({part.strip()}) AS tot FROM ({points})) {group}))"""


SPANS = f"""SELECT *, CASE WHEN t > 0 THEN t END AS total_h, CASE WHEN merged_at IS NOT NULL AND c > 0 THEN c END AS coding_h,
  CASE WHEN r > 0 THEN r END AS review_h
  FROM (SELECT *, {HOURS('merged_at', 'coalesce(first_commit_at, created_at)')} AS t,
        {HOURS('created_at', 'coalesce(first_commit_at, created_at)')} AS c,
        {HOURS('merged_at', 'created_at')} AS r FROM v_prs)"""
Q = "coalesce(quantile_cont({0}, {1}), 0)"
PROD = "contains(lower(environment), 'prod')"


def LEAD(keys=""):
    k = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    has = (
        f"CASE WHEN {keys} IN (SELECT {keys} FROM v_deps) THEN 2.0 ELSE 0.0 END"
        if keys
        else "CASE WHEN (SELECT count(*) FROM v_deps) > 0 THEN 2.0 ELSE 0.0 END"
    )
    return f"""SELECT {k}{R2('med')} AS median, {R2('mn')} AS mean, {R2('p')} AS p90, {BAND('med', 24, 168, 720)} AS level,
      {R2('c')} AS coding, 0.0::DOUBLE AS pickup, {R2('r')} AS review, CAST({has} AS DOUBLE) AS deploy
      FROM (SELECT {k}{Q.format('total_h', 0.5)} AS med, coalesce(avg(total_h), 0) AS mn, {Q.format('total_h', 0.9)} AS p,
                   {Q.format('coding_h', 0.5)} AS c, {Q.format('review_h', 0.5)} AS r FROM ({SPANS}) {group})"""


# repositories known only to deployments have no lead time
LEAD_ALL = f"""{LEAD("repo")} UNION ALL SELECT DISTINCT repo, 0.0, 0.0, 0.0, 'elite', 0.0, 0.0, 0.0, 0.0 FROM v_deps
  WHERE repo NOT IN (SELECT repo FROM v_prs)"""
LEAD_POINTS = f"SELECT repo, merged_at AS date, id, total_h AS value FROM ({SPANS}) WHERE total_h IS NOT NULL"
MARKED = f"""SELECT d.*, status = 'failure' OR EXISTS (SELECT 1 FROM v_incidents i
   WHERE epoch_ms(coalesce(i.incident_start, i.created)) > epoch_ms(coalesce(d.completed_at, d.created_at)) - 3600000
     AND epoch_ms(coalesce(i.incident_start, i.created)) < epoch_ms(coalesce(d.completed_at, d.created_at)) + 90000000) AS failed
   FROM v_deps d WHERE {PROD}"""
CFR_POINTS = f"SELECT repo, created_at AS date, id, CASE WHEN status = 'failure' THEN 1 ELSE 0 END AS value FROM v_deps WHERE {PROD}"
REC = f"""SELECT *, CASE WHEN h >= 0 THEN h END AS hh FROM (SELECT *, {HOURS('coalesce(incident_resolution, resolved)',
   'coalesce(incident_start, created)')} AS h FROM v_incidents WHERE is_incident)"""
REC_POINTS = f"SELECT repo, coalesce(incident_start, created) AS date, id, hh AS value FROM ({REC}) WHERE hh IS NOT NULL"


def FREQ(keys="", days=20):
    k = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {k}n AS deployments, {R2('CASE WHEN x >= 1 THEN x WHEN x >= 1/7.0 THEN x * 7 ELSE x * 30 END')} AS value,
      CASE WHEN x >= 1 THEN 'day' WHEN x >= 1/7.0 THEN 'week' ELSE 'month' END AS unit, {FREQ_BAND('x')} AS level,
      'stable' AS trend FROM (SELECT {k}count(*) FILTER (status = 'success' AND {PROD}) AS n,
      count(*) FILTER (status = 'success' AND {PROD}) / {days}.0::DOUBLE AS x FROM v_deps {group})"""


def CFR(keys=""):
    k = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {k}{R2('rt')} AS rate, n AS total_deployments, f AS failed_deployments, {BAND('rt', 5, 10, 15)} AS level
      FROM (SELECT *, CASE WHEN n > 0 THEN f / n::DOUBLE * 100 ELSE 0.0 END AS rt FROM (
        SELECT {k}count(*) AS n, count(*) FILTER (failed) AS f FROM ({MARKED}) {group}))"""


def RECOVERY(keys=""):
    k = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {k}{R2('med')} AS median, {R2('mn')} AS mean, {R2('p')} AS p90, {BAND('med', 1, 24, 168)} AS level,
      n AS incidents FROM (SELECT {k}{Q.format('hh', 0.5)} AS med, coalesce(avg(hh), 0) AS mn, {Q.format('hh', 0.9)} AS p,
      count(*) AS n FROM ({REC}) {group})"""


@query("deployment_frequency", FREQ())
def _(t):
    return d.deployment_frequency(t.deps, E0, E1)


@query("deployment_frequency_by_repo", FREQ("repo"))
def _(t):
    return d.deployment_frequency(t.deps, E0, E1, ["repo"])


@query("lead_time", f"SELECT * FROM ({LEAD()}), ({TREND(LEAD_POINTS, True)})")
def _(t):
    return d.lead_time(t.prs, t.deps)


@query(
    "lead_time_by_repo",
    f"SELECT a.*, coalesce(trend, 'stable') AS trend FROM ({LEAD_ALL}) a "
    f"LEFT JOIN ({TREND(LEAD_POINTS, True, 'repo')}) b ON a.repo = b.repo",
)
def _(t):
    return d.lead_time(t.prs, t.deps, ["repo"])


@query("change_failure_rate", f"SELECT * FROM ({CFR()}), ({TREND(CFR_POINTS, True)})")
def _(t):
    return d.change_failure_rate(t.deps, t.incidents)


@query("incident_within_24h", f"SELECT id, status, failed FROM ({MARKED})")
def _(t):
    return d.incident_within_24h(t.deps, t.incidents).select("id", "status", "failed")


@query("recovery_time", f"SELECT * FROM ({RECOVERY()}), ({TREND(REC_POINTS, True)})")
def _(t):
    return d.recovery_time(t.incidents)


RANK = "CASE {0} WHEN 'elite' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END"


def _worst(*cols):
    return f"CASE greatest({', '.join(RANK.format(c) for c in cols)}) WHEN 1 THEN 'elite' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' ELSE 'low' END"


METRICS = f"""WITH f AS ({FREQ()}), l AS ({LEAD()}), lt AS ({TREND(LEAD_POINTS, True)}), c AS ({CFR()}),
  ct AS ({TREND(CFR_POINTS, True)}), r AS ({RECOVERY()}), rt AS ({TREND(REC_POINTS, True)})
  SELECT f.value AS frequency_value, f.unit AS frequency_unit, f.level AS frequency_level, l.median AS lead_median,
    l.p90 AS lead_p90, l.level AS lead_level, lt.trend AS lead_trend, c.rate AS failure_rate, c.level AS failure_level,
    ct.trend AS failure_trend, r.median AS recovery_median, r.level AS recovery_level, rt.trend AS recovery_trend,
    {_worst('f.level', 'l.level', 'c.level', 'r.level')} AS overall_level
  FROM f, l, lt, c, ct, r, rt"""


@query("delivery_metrics", METRICS)
def _(t):
    return d.delivery_metrics(t.prs, t.deps, t.incidents, E0, E1)


def _by(name, keys="repo"):
    return f"coalesce({name}, 'stable')"


@query(
    "delivery_metrics_by_repo",
    f"""WITH f AS ({FREQ('repo')}), l AS ({LEAD('repo')}), lt AS ({TREND(LEAD_POINTS, True, 'repo')}), c AS ({CFR('repo')}),
  ct AS ({TREND(CFR_POINTS, True, 'repo')}), r AS ({RECOVERY('repo')}), rt AS ({TREND(REC_POINTS, True, 'repo')}),
  k AS (SELECT repo FROM f UNION SELECT repo FROM l UNION SELECT repo FROM c UNION SELECT repo FROM r),
  j AS (SELECT k.repo, coalesce(f.value, 0) AS frequency_value, coalesce(f.unit, 'month') AS frequency_unit,
    coalesce(f.level, 'low') AS frequency_level, coalesce(l.median, 0) AS lead_median, coalesce(l.p90, 0) AS lead_p90,
    coalesce(l.level, 'elite') AS lead_level, coalesce(lt.trend, 'stable') AS lead_trend, coalesce(c.rate, 0) AS failure_rate,
    coalesce(c.level, 'elite') AS failure_level, coalesce(ct.trend, 'stable') AS failure_trend,
    coalesce(r.median, 0) AS recovery_median, coalesce(r.level, 'elite') AS recovery_level,
    coalesce(rt.trend, 'stable') AS recovery_trend
   FROM k LEFT JOIN f USING (repo) LEFT JOIN l USING (repo) LEFT JOIN lt USING (repo) LEFT JOIN c USING (repo)
    LEFT JOIN ct USING (repo) LEFT JOIN r USING (repo) LEFT JOIN rt USING (repo))
  SELECT *, {_worst('frequency_level', 'lead_level', 'failure_level', 'recovery_level')} AS overall_level FROM j""",
)
def _(t):
    return d.delivery_metrics(t.prs, t.deps, t.incidents, E0, E1, ["repo"])


@query(
    "performance_levels",
    f"""SELECT id, {FREQ_BAND('value / 100')} AS frequency, {BAND('value * 10', 24, 168, 720)} AS lead,
      {BAND('value / 5', 5, 10, 15)} AS failure, {BAND('value', 1, 24, 168)} AS recovery,
      {_worst(FREQ_BAND('value / 100'), BAND('value * 10', 24, 168, 720), BAND('value / 5', 5, 10, 15), BAND('value', 1, 24, 168))
       .replace('CASE CASE', 'CASE (CASE').replace("ELSE 'low' END WHEN 'elite' THEN 1", "ELSE 'low' END) WHEN 'elite' THEN 1")} AS overall
      FROM v_issues""",
)
def _(t):
    v = F.col("value")
    bands = [
        levels.level_frequency(v / 100),
        levels.level_lead_time(v * 10),
        levels.level_failure_rate(v / 5),
        levels.level_recovery(v),
    ]
    return t.issues.select(
        "id",
        *[b.alias(n) for b, n in zip(bands, ["frequency", "lead", "failure", "recovery"])],
        levels.overall_level(*bands).alias("overall"),
    )


@query(
    "percentile_linear",
    "SELECT repo, coalesce(quantile_cont(changed_files, 0.9), 0) AS p90, coalesce(median(changed_files), 0) AS median, "
    "coalesce(avg(changed_files), 0) AS mean FROM v_prs GROUP BY repo",
)
def _(t):
    c = F.col("changed_files")
    ranks = d.percentile_linear(t.prs, ["repo"], c, {"p90": 0.9, "median": 0.5})
    return ranks.join(t.prs.groupBy("repo").agg(d.mean_or_zero(c).alias("mean")), "repo")


@query("trend", TREND("SELECT repo, created_at AS date, id, changed_files AS value FROM v_prs", False, "repo"))
def _(t):
    points = t.prs.select("repo", F.col("created_at").alias("date"), "id", F.col("changed_files").alias("value"))
    return trend(points, ["repo"])


def WEEKLY(points, keys="", week="(date_trunc('week', CAST(date AS DATE) + 1)::DATE - 1)"):
    k = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    using = f"{k}week"
    return f"""WITH w AS (SELECT {k}{week} AS week, avg(value) AS m, count(*) AS c FROM ({points}) GROUP BY ALL),
      s AS (SELECT {k}unnest(generate_series(min(week)::TIMESTAMP, max(week)::TIMESTAMP, INTERVAL 7 DAY))::DATE AS week FROM w {group})
      SELECT {k}strftime(week, '%Y-%m-%d') AS week, round(coalesce(m, 0), 4) AS value, coalesce(c, 0) AS n
      FROM s LEFT JOIN w USING ({using})"""


def _week_out(df):
    return df.withColumn("week", F.date_format("week", "yyyy-MM-dd")).withColumn("value", F.round("value", 4))


@query(
    "weekly_series",
    WEEKLY("SELECT repo, merged_at AS date, (epoch_ms(merged_at) - epoch_ms(created_at)) / 3600000.0 AS value "
           "FROM v_prs WHERE merged_at IS NOT NULL", "repo"),
)
def _(t):
    return _week_out(weekly_series(d.lead_time_points(t.prs), ["repo"]))


@query("weekly_deployments", WEEKLY(f"SELECT created_at AS date, 1 AS value FROM v_deps WHERE status = 'success' AND {PROD}"))
def _(t):
    return _week_out(weekly_series(d.deployment_points(t.deps)))


@query("deployment_points", f"SELECT id, epoch_ms(created_at) AS date, 1.0::DOUBLE AS value FROM v_deps WHERE status = 'success' AND {PROD}")
def _(t):
    return d.deployment_points(t.deps).select("id", ms("date"), "value")


@query("lead_time_points", "SELECT id, epoch_ms(merged_at) AS date, (epoch_ms(merged_at) - epoch_ms(created_at)) / 3600000.0 AS value "
       "FROM v_prs WHERE merged_at IS NOT NULL")
def _(t):
    return d.lead_time_points(t.prs).select("id", ms("date"), "value")


@query("diff_units", f"SELECT id, {HOURS('resolved', 'created')} AS hours, "
       "CAST(trunc((epoch_ms(resolved) - epoch_ms(created)) / 86400000.0) AS BIGINT) AS days FROM v_issues")
def _(t):
    r, c = F.col("resolved"), F.col("created")
    return t.issues.select("id", diff_hours(r, c).alias("hours"), diff_days(r, c).alias("days"))


# ---- shaping


@query("merged_prs", f"SELECT id, coalesce(author, 'unknown') AS author, epoch_ms(merged_at) AS merged_at, "
       f"epoch_ms(created_at) AS first_commit_at FROM v_prs WHERE state = 'closed' AND merged_at {IN_P}")
def _(t):
    return d.merged_prs(t.prs, P0, P1).select("id", "author", ms("merged_at"), ms("first_commit_at"))


STATUSES = """SELECT user_id AS deployment_id, event_id AS status_id, ts AS status_at,
  CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure' WHEN 'view' THEN 'queued' ELSE 'in_progress' END AS state FROM events"""
PLACES = "CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'staging' ELSE 'production' END"
LATEST = f"""SELECT '{{0}}' AS asked, t.ticket_key AS id, coalesce(nullif(environment, ''), 'unknown') AS environment, coalesce(state, 'pending') AS status, epoch_ms(status_at) AS completed_at
      FROM (SELECT *, {PLACES} AS environment FROM v_tickets) t LEFT JOIN s ON t.id = s.deployment_id AND rn = 1
      WHERE created_at BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-25'"""


@query(
    "deployments_latest_status",
    f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY deployment_id ORDER BY status_at DESC, status_id DESC) AS rn
      FROM ({STATUSES}))
      {LATEST.format('all')} UNION ALL {LATEST.format('production')} AND environment = 'production'""",
)
def _(t):
    state = F.expr("CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure' WHEN 'view' THEN 'queued' ELSE 'in_progress' END")
    statuses = t.events.select(
        F.col("user_id").alias("deployment_id"), F.col("event_id").alias("status_id"), F.col("ts").alias("status_at"),
        state.alias("state"),
    )
    deployments = t.tickets.select("id", "ticket_key", "created_at", F.expr(PLACES).alias("environment"))
    parts = []
    for asked in (None, "production"):
        latest = d.deployments_latest_status(deployments, statuses, utc(2024, 1, 1), utc(2024, 1, 25), asked)
        parts.append(latest.select(F.lit(asked or "all").alias("asked"), F.col("ticket_key").alias("id"), "environment", "status", ms("completed_at")))
    return parts[0].unionByName(parts[1])


@query("workflow_runs_filter", f"SELECT id, name FROM v_runs WHERE created_at {IN_E} AND contains(path, 'error.yml')")
def _(t):
    return d.workflow_runs_filter(t.runs, E0, E1, "error.yml").select("id", "name")


@query("runs_to_deployments", "SELECT CAST(id AS STRING) AS id, 'production' AS environment, coalesce(conclusion, 'pending') AS status, "
       "epoch_ms(completed_at) AS completed_at, head_sha AS sha FROM (SELECT *, updated_at AS completed_at FROM v_runs) "
       "WHERE regexp_matches(lower(name), 'deploy|release|prod')")
def _(t):
    return d.runs_to_deployments(t.runs).select("id", "environment", "status", ms("completed_at"), "sha")


@query("deployments_or_fallback", "SELECT 'pr-' || number AS id, 'success' AS status, number AS pr_number, repo FROM v_prs "
       "WHERE merged_at IS NOT NULL")
def _(t):
    none = t.deps.filter("status = 'cancelled'")  # no deployment has this status
    return d.deployments_or_fallback(none, t.prs).select("id", "status", "pr_number", "repo")


@query("deployments_of_prs", "SELECT id, pr_number FROM v_deps WHERE pr_number IN (SELECT number FROM v_prs WHERE merged_at IS NOT NULL)")
def _(t):
    return d.deployments_of_prs(t.deps, t.prs.filter("merged_at is not null")).select("id", "pr_number")


def _kinds(parts):
    prs, deps, incs = parts
    rows = prs.select(F.lit("pr").alias("kind"), F.col("id").cast("string").alias("id"))
    rows = rows.unionByName(deps.select(F.lit("dep").alias("kind"), "id"))
    return rows.unionByName(incs.select(F.lit("inc").alias("kind"), F.col("id").cast("string").alias("id")))


LABEL = "len(list_filter(labels, lambda x: contains(lower(x), 'urgent') OR contains(lower(x), 'p1'))) > 0"


@query(
    "filter_by_feature",
    f"""WITH p AS (SELECT * FROM v_prs WHERE {LABEL})
    SELECT 'pr' AS kind, CAST(id AS STRING) AS id FROM p
    UNION ALL SELECT 'dep', id FROM v_deps WHERE pr_number IN (SELECT number FROM p)
    UNION ALL SELECT 'inc', CAST(id AS STRING) FROM v_issues WHERE {LABEL} OR contains(lower(epic), 'p1')""",
)
def _(t):
    incs = t.issues.withColumn("feature_key", F.col("epic"))
    return _kinds(d.filter_by_feature(t.prs, t.deps, incs, ["URGENT", "p1"]))


@query(
    "delivery_slice",
    """SELECT 'pr' AS kind, CAST(id AS STRING) AS id FROM v_prs WHERE repo = 'NATION_3' AND merged_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2024-01-25'
    UNION ALL SELECT 'dep', id FROM v_deps WHERE repo = 'NATION_3' AND created_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2024-01-25'
    UNION ALL SELECT 'inc', CAST(id AS STRING) FROM v_incidents WHERE created BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2024-01-25'""",
)
def _(t):
    return _kinds(d.delivery_slice(t.prs, t.deps, t.incidents, P0, E1, repo="NATION_3"))


FIRST_USE = """SELECT label, count(*) AS n, min(id * 10 + pos) AS first FROM (SELECT id, unnest(labels) AS label,
  generate_subscripts(labels, 1) AS pos FROM v_prs) GROUP BY label HAVING count(*) >= 2 ORDER BY first LIMIT 10"""


@query("feature_labels", f"SELECT label, n FROM ({FIRST_USE})")
def _(t):
    return d.feature_labels(t.prs)


@query(
    "slice_counts",
    f"""SELECT (SELECT count(*) FROM v_prs) AS prs, (SELECT count(*) FROM v_deps) AS deployments,
      (SELECT count(*) FROM v_incidents) AS incidents,
      (SELECT count(*) FROM (SELECT repo FROM v_prs UNION SELECT repo FROM v_deps)) AS repos,
      (SELECT count(*) FROM ({FIRST_USE})) AS features, CAST(1827 AS BIGINT) AS days""",
)
def _(t):
    return d.slice_counts(t.prs, t.deps, t.incidents, d.feature_labels(t.prs), P0, utc(2000, 12, 31, 12))


@query(
    "lead_time_shares",
    f"""WITH m AS (SELECT *, coding + pickup + review + deploy AS whole FROM ({LEAD_ALL})),
    u AS (UNPIVOT m ON coding, pickup, review, deploy INTO NAME phase VALUE hours)
    SELECT repo, phase, hours, {R2('CASE WHEN whole = 0 THEN 25.0 ELSE hours / whole * 100 END')} AS percent FROM u""",
)
def _(t):
    metric = d.lead_time(t.prs, t.deps, ["repo"])
    return d.lead_time_shares(metric, ["repo"])


@query(
    "repo_comparison",
    """SELECT repo, CAST(sum(p) AS BIGINT) AS pr_count, CAST(sum(r) AS BIGINT) AS run_count FROM (
      SELECT repo, 1 AS p, 0 AS r FROM v_prs UNION ALL SELECT repo, 0, 1 FROM v_runs) GROUP BY repo""",
)
def _(t):
    return d.repo_comparison(t.prs, t.runs)


# ---- issues

IS_INCIDENT = """(regexp_matches(lower(issue_type), 'bug|incident|outage|hotfix|defect')
  OR len(list_filter(labels, lambda x: regexp_matches(lower(x), 'incident|outage|production-issue|p0|p1|critical'))) > 0)"""


@query("classify_incident", f"SELECT id, {IS_INCIDENT} AS is_incident FROM v_issues")
def _(t):
    return t.issues.select("id", d.classify_incident(F.col("issue_type"), F.col("labels")).alias("is_incident"))


@query("incidents_in_period", f"SELECT id, key, issue_type FROM v_issues WHERE project_key = 'PRJ2' AND issue_type IN ('Bug', 'Task') "
       f"AND CAST(created AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' AND {IS_INCIDENT}")
def _(t):
    return d.incidents_in_period(t.issues, "PRJ2", E0, E1, ["Bug", "Task"]).select("id", "key", "issue_type")


@query("incident_issues", "SELECT id, key FROM v_issues WHERE created <= TIMESTAMP '2024-01-25' AND issue_type <> 'Sub-task' "
       "AND len(list_filter(labels, lambda x: x IN ('P1', 'Outage-note'))) > 0")
def _(t):
    raw = t.issues.withColumn("is_pull_request", F.col("issue_type") == "Sub-task")
    twice = raw.unionByName(raw.filter("value > 100"))  # an issue is listed once per label that fetched it
    return d.incident_issues(twice, E1, ["P1", "Outage-note"]).select("id", "key")


@query("issues_by_epic", "SELECT id, key FROM v_issues WHERE epic = 'EPIC-7'")
def _(t):
    return d.issues_by_epic(t.issues, "EPIC-7").select("id", "key")


@query("issues_by_label", f"SELECT id, key FROM v_issues WHERE project_key = 'PRJ1' AND list_contains(labels, 'P1') AND created {IN_E}")
def _(t):
    return d.issues_by_label(t.issues, "PRJ1", "P1", E0, E1).select("id", "key")


@query("issues_to_incidents", """SELECT id, 'WEB-' || id AS key, CASE WHEN resolved IS NOT NULL THEN 'Done' ELSE 'In Progress' END AS status,
   CASE WHEN id % 3 = 0 THEN 'Critical' ELSE 'Medium' END AS priority, epoch_ms(created) AS incident_start,
   epoch_ms(resolved) AS incident_resolution FROM v_issues""")
def _(t):
    tracker = t.issues.select(
        "id", F.col("id").alias("number"), F.col("summary").alias("title"), "created", F.col("resolved").alias("closed"),
        F.when(F.col("resolved").isNotNull(), "closed").otherwise("open").alias("state"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit("critical"))).otherwise(F.array(F.lit("minor"))).alias("labels"),
    )
    return d.issues_to_incidents(tracker, "WEB").select(
        "id", "key", "status", "priority", ms("incident_start"), ms("incident_resolution")
    )


def issue_json(issues):
    """Nested issue JSON text, as an API would land it, from the issue rows."""
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    body = F.struct(
        F.col("id").cast("string").alias("id"),
        "key",
        F.struct(
            "summary",
            F.struct(F.col("issue_type").alias("name")).alias("issuetype"),
            F.struct(
                F.col("status_key").alias("name"), F.struct(F.col("status_key").alias("key")).alias("statusCategory")
            ).alias("status"),
            F.struct(F.col("priority").alias("name")).alias("priority"),
            F.date_format("created", iso).alias("created"),
            F.date_format("updated", iso).alias("updated"),
            F.date_format("resolved", iso).alias("resolutiondate"),
            F.when(F.col("id") % 11 != 0, F.col("labels")).alias("labels"),
            F.when(F.col("id") % 7 != 0, F.array(F.struct(F.col("epic").alias("name")))).alias("components"),
            F.struct(F.col("project_key").alias("key")).alias("project"),
            F.when(
                F.col("assignee").isNotNull(),
                F.struct(F.col("assignee").alias("displayName"), F.concat(F.lit("acc-"), "assignee").alias("accountId")),
            ).alias("assignee"),
            F.struct(F.concat(F.lit("rep"), "user_id").alias("displayName"), F.lit("r1").alias("accountId")).alias("reporter"),
            F.struct(F.col("epic").alias("key")).alias("parent"),
            F.concat(F.lit("S"), F.col("id") % 6).alias("customfield_10104"),
            F.col("story_points").alias("customfield_10016"),
        ).alias("fields"),
    )
    return spread(issues).select(F.to_json(body).alias("raw"))


@query(
    "normalize_issue",
    f"""SELECT CAST(id AS STRING) AS id, key, summary, issue_type, status_key AS status, priority, epoch_ms(created) AS created,
     epoch_ms(resolved) AS resolved, array_to_string(labels, ',') AS labels, CASE WHEN id % 7 <> 0 THEN epic ELSE '' END AS components,
     project_key, assignee, epic, {IS_INCIDENT} AS is_incident
     FROM (SELECT * REPLACE (CASE WHEN id % 11 <> 0 THEN labels ELSE [] END AS labels) FROM v_issues)""",
)
def _(t):
    flat = d.normalize_issue(issue_json(t.issues))
    return flat.select(
        "id", "key", "summary", "issue_type", "status", "priority", ms("created"), ms("resolved"),
        F.array_join("labels", ",").alias("labels"), F.array_join("components", ",").alias("components"),
        "project_key", "assignee", "epic", "is_incident",
    )
