"""Lifecycle, usage and evaluation queries and their oracle texts."""

from pyspark.sql import functions as F

from sparkgauge.functions import scoring
from sparkgauge.functions.textfns import estimate_tokens, extract_ticket_ids
from sparkgauge.operators import evals as e
from sparkgauge.operators import lifecycle as lc
from sparkgauge.operators import usage as u
from sparkgauge.plans.delivery_queries import E0, E1, IN_E, issue_json, ms
from sparkgauge.plans.registry import query
from sparkgauge.sources import tablework as w
from sparkgauge.sources.tables import spread

# ---- imports


@query("extract_ticket_ids", """SELECT seq, array_to_string(list_filter(xs, lambda x, i: list_position(xs, x) = i), ',') AS tickets
  FROM (SELECT seq, regexp_extract_all(message, '\\b[A-Z][A-Z0-9]+-\\d+\\b') AS xs FROM v_commits)""")
def _(t):
    return t.commits.select("seq", F.array_join(extract_ticket_ids(F.col("message")), ",").alias("tickets"))


@query("issue_to_ticket", """SELECT CAST(id AS STRING) AS jira_id, key AS ticket_key, issue_type, priority, status_key AS current_status,
  CASE status_key WHEN 'done' THEN 'Done' WHEN 'new' THEN 'To Do' ELSE 'In Progress' END AS status_category, assignee,
  'rep' || user_id AS reporter, 'S' || id % 6 AS sprint, story_points, epoch_ms(created) AS created_at, epoch_ms(resolved) AS resolved_at FROM v_issues""")
def _(t):
    return lc.issue_to_ticket(issue_json(t.issues), F.lit("CS-1")).select(
        "jira_id", "ticket_key", "issue_type", "priority", "current_status", "status_category", "assignee", "reporter",
        "sprint", "story_points", ms("created_at"), ms("resolved_at"),
    )


@query("import_issues", """SELECT key AS ticket_key, 'ticket_created' AS event_type, epoch_ms(created) AS event_date, 'rep' || user_id AS actor_name FROM v_issues
  UNION ALL SELECT key, 'resolved', epoch_ms(resolved), coalesce(assignee, 'Unknown') FROM v_issues WHERE resolved IS NOT NULL""")
def _(t):
    _, events = lc.import_issues(issue_json(t.issues), F.lit("CS-1"))
    return events.select("ticket_key", "event_type", ms("event_date"), "actor_name")


def changelog_json(t):
    def item(field, before, after):
        return F.struct(field.alias("field"), before.alias("fromString"), after.alias("toString"))

    kind = F.expr("CASE event_type WHEN 'click' THEN 'status' WHEN 'purchase' THEN 'status' WHEN 'view' THEN 'resolution' ELSE 'assignee' END")
    items = F.array(
        item(kind, F.lit("To Do"), F.col("event_type")), item(F.lit("status"), F.lit(""), F.concat(F.lit("S"), F.col("event_id") % 3))
    )
    history = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created"), items.alias("items"))
    body = F.struct(F.concat(F.lit("PROJ-"), "user_id").alias("key"), F.array(history).alias("histories"))
    return spread(t.events).select(F.to_json(body).alias("raw"))


@query("import_changelog", """SELECT 'PROJ-' || user_id AS ticket_key, CASE WHEN event_type IN ('click', 'purchase') THEN 'status_changed' ELSE 'assignee_changed' END AS event_type,
   epoch_ms(ts) AS event_date, CASE WHEN event_type IN ('click', 'purchase') THEN 'To Do' END AS from_status,
   CASE WHEN event_type IN ('click', 'purchase') THEN event_type END AS to_status FROM events WHERE event_type <> 'view'
  UNION ALL SELECT 'PROJ-' || user_id, 'status_changed', epoch_ms(ts), NULL, 'S' || event_id % 3 FROM events""")
def _(t):
    return lc.import_changelog(changelog_json(t), F.lit("CS-1")).select(
        "ticket_key", "event_type", ms("event_date"), "from_status", "to_status"
    )


COMMIT_EVENTS = f"""SELECT case_study_id, unnest(list_distinct(regexp_extract_all(message, '\\b[A-Z][A-Z0-9]+-\\d+\\b'))) AS ticket_key, sha, seq, committed_at
  FROM v_commits WHERE committed_at {IN_E}"""


@query("import_commits", f"SELECT case_study_id, ticket_key, sha AS commit_sha, epoch_ms(committed_at) AS event_date FROM ({COMMIT_EVENTS})")
def _(t):
    return lc.import_commits(t.commits, E0, E1).select("case_study_id", "ticket_key", "commit_sha", ms("event_date"))


@query("import_commits_newest", f"""WITH k AS (SELECT DISTINCT sha, committed_at FROM ({COMMIT_EVENTS}) ORDER BY committed_at DESC, sha LIMIT 500)
  SELECT ticket_key, sha AS commit_sha FROM ({COMMIT_EVENTS}) WHERE sha IN (SELECT sha FROM k)""")
def _(t):
    return lc.import_commits(t.commits, E0, E1, max_commits=500).select("ticket_key", "commit_sha")


@query("union_events", """SELECT ticket_key, event_type, event_source, to_status FROM v_levents UNION ALL
  SELECT unnest(list_distinct(regexp_extract_all(message, '\\b[A-Z][A-Z0-9]+-\\d+\\b'))), 'commit_created', 'github', NULL FROM v_commits""")
def _(t):
    both = lc.union_events(t.levents, lc.import_commits(t.commits))
    return both.select("ticket_key", "event_type", "event_source", "to_status")


# ---- lookups


@query("tickets_by", "SELECT id, ticket_key FROM v_tickets WHERE case_study_id = 'CS-2' AND status_category = 'Done'")
def _(t):
    return lc.tickets_by(t.tickets, "CS-2", category="Done").select("id", "ticket_key")


@query("events_by", f"SELECT id, ticket_key FROM v_levents WHERE case_study_id = 'CS-3' AND event_type = 'status_changed' AND event_source = 'jira' AND event_date {IN_E}")
def _(t):
    return lc.events_by(t.levents, "CS-3", None, "status_changed", "jira", E0, E1).select("id", "ticket_key")


@query("studies_by", "SELECT id, name FROM v_studies WHERE status = 'completed' AND type = 'sprint'")
def _(t):
    return lc.studies_by(t.studies, "completed", "sprint").select("id", "name")


@query("ticket_events", "SELECT t.ticket_key, e.id AS event_id FROM v_tickets t LEFT JOIN v_levents e ON t.ticket_key = e.ticket_key AND t.case_study_id = e.case_study_id")
def _(t):
    return lc.ticket_events(t.tickets, t.levents).select("ticket_key", F.col("id").alias("event_id"))


@query("correlated_tickets", "SELECT ticket_key FROM v_tickets WHERE ticket_key IN (SELECT ticket_key FROM v_levents GROUP BY 1 "
       "HAVING bool_or(event_source = 'jira') AND bool_or(event_source = 'github'))")
def _(t):
    return lc.correlated_tickets(t.tickets, t.levents).select("ticket_key")


@query("ticket_timeline", "SELECT ticket_key, id, row_number() OVER (PARTITION BY ticket_key ORDER BY event_date, id) - 1 AS position, "
       "count(*) OVER (PARTITION BY ticket_key) AS total FROM v_levents")
def _(t):
    return lc.ticket_timeline(t.levents).select("ticket_key", "id", "position", "total")


# ---- metrics

MEASURED = """SELECT t.*, epoch_ms(resolved_at) - epoch_ms(created_at) AS lead_time, epoch_ms(done) - epoch_ms(progress) AS cycle_time
  FROM v_tickets t LEFT JOIN (SELECT ticket_key, case_study_id, min(event_date) FILTER (contains(to_status, 'Progress')) AS progress,
   min(event_date) FILTER (contains(to_status, 'Done')) AS done FROM v_levents WHERE event_type = 'status_changed' GROUP BY 1, 2) e
  ON t.ticket_key = e.ticket_key AND t.case_study_id = e.case_study_id"""


@query("ticket_metrics", f"SELECT ticket_key, lead_time, cycle_time FROM ({MEASURED})")
def _(t):
    return lc.ticket_metrics(t.tickets, t.levents).select("ticket_key", "lead_time", "cycle_time")


@query("average_metrics", f"""SELECT case_study_id, round(coalesce(avg(lead_time), 0), 3) AS avg_lead_time, round(coalesce(avg(cycle_time), 0), 3) AS avg_cycle_time,
  round(coalesce(avg(story_points), 0), 3) AS avg_story_points FROM ({MEASURED}) WHERE resolved_at IS NOT NULL GROUP BY 1""")
def _(t):
    out = lc.average_metrics(lc.ticket_metrics(t.tickets, t.levents))
    return out.select("case_study_id", *[F.round(c, 3).alias(c) for c in out.columns[1:]])


@query("tickets_by_status_count", "SELECT case_study_id, current_status, count(*) AS n FROM v_tickets GROUP BY ALL")
def _(t):
    return lc.tickets_by_status_count(t.tickets)


@query("events_by_type_count", "SELECT case_study_id, event_type, count(*) AS n FROM v_levents GROUP BY ALL")
def _(t):
    return lc.events_by_type_count(t.levents)


@query("events_by_source_count", "SELECT case_study_id, count(*) FILTER (event_source = 'jira') AS jira, count(*) FILTER (event_source = 'github') AS github FROM v_levents GROUP BY 1")
def _(t):
    return lc.events_by_source_count(t.levents)


@query("studies_by_status_count", "SELECT status, count(*) AS n FROM v_studies GROUP BY 1")
def _(t):
    return lc.studies_by_status_count(t.studies)


@query("study_rollup", """SELECT case_study_id, tc AS ticket_count, ec AS event_count, epoch_ms(s) AS start_date, epoch_ms(e) AS end_date FROM
  (SELECT case_study_id, count(*) AS tc, min(created_at) AS s, max(created_at) AS e FROM v_tickets GROUP BY 1)
  JOIN (SELECT case_study_id, count(*) AS ec FROM v_levents GROUP BY 1) USING (case_study_id)""")
def _(t):
    r = lc.study_rollup(t.tickets, t.levents)
    return r.select("case_study_id", "ticket_count", "event_count", ms("start_date"), ms("end_date"))


@query("metrics_summary", f"""SELECT count(*) AS total_tickets, count(*) FILTER (status_category = 'Done') AS completed_tickets,
  round(avg(cycle_time), 3) AS avg_cycle_time, round(avg(lead_time), 3) AS avg_lead_time,
  (SELECT count(*) FROM v_levents WHERE event_type = 'commit_created') AS total_commits, (SELECT count(*) FROM v_prs) AS total_prs,
  sum(story_points) FILTER (status_category = 'Done') AS velocity_points FROM ({MEASURED})""")
def _(t):
    m = lc.metrics_summary(lc.ticket_metrics(t.tickets, t.levents), t.levents, t.prs)
    return m.withColumn("avg_cycle_time", F.round("avg_cycle_time", 3)).withColumn("avg_lead_time", F.round("avg_lead_time", 3))


@query("cascade_delete", """SELECT 'ticket' AS kind, id FROM v_tickets WHERE case_study_id NOT IN ('CS-1', 'CS-4')
  UNION ALL SELECT 'event', id FROM v_levents WHERE case_study_id NOT IN ('CS-1', 'CS-4')""")
def _(t):
    doomed = t.tickets.filter(F.col("case_study_id").isin("CS-1", "CS-4")).select("case_study_id").distinct()
    tickets, events = w.cascade_delete(doomed, "case_study_id", t.tickets, t.levents)
    return tickets.select(F.lit("ticket").alias("kind"), "id").unionByName(events.select(F.lit("event").alias("kind"), "id"))


# ---- usage

STATS = """count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
  CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens, round(avg(prompt_tokens + completion_tokens), 6) AS avg_tokens_per_call,
  max(prompt_tokens + completion_tokens) AS max_tokens_in_call, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms"""


def _r6(df):
    return df.withColumn("avg_tokens_per_call", F.round("avg_tokens_per_call", 6))


@query("usage_by_model", f"SELECT model_id, {STATS} FROM v_usage GROUP BY 1")
def _(t):
    return _r6(u.usage_by_model(t.usage))


@query("usage_overall", f"SELECT model_id, {STATS} FROM v_usage GROUP BY ROLLUP (model_id)")
def _(t):
    return _r6(u.usage_overall(t.usage))


@query("usage_in_range", "SELECT seq, model_id FROM v_usage WHERE ts_ms BETWEEN 1704150000000 AND 1704330000000")
def _(t):
    return u.usage_in_range(t.usage, 1704150000000, 1704330000000).select("seq", "model_id")


@query("recent_usage", "SELECT seq, model_id FROM v_usage ORDER BY seq DESC LIMIT 25")
def _(t):
    return u.recent_usage(t.usage, 25).select("seq", "model_id")


RESOLVED = """SELECT seq, model_id, CASE model_id WHEN 'gpt-4o-mini-2024' THEN 'GPT-4o' WHEN 'Claude-3.5-Sonnet-x' THEN 'Claude 3.5 Sonnet'
  WHEN 'o1-preview' THEN 'o1 Preview' WHEN 'GPT-3.5-turbo-16k' THEN 'GPT-3.5 Turbo' ELSE model_id END AS family,
  CASE WHEN regexp_matches(lower(model_id), 'gpt|o1') THEN 'OpenAI' WHEN contains(lower(model_id), 'claude') THEN 'Anthropic'
   WHEN contains(model_id, 'gemini') THEN 'Google' ELSE 'Unknown' END AS vendor,
  CAST(CASE model_id WHEN 'gpt-4o-mini-2024' THEN 128000 WHEN 'Claude-3.5-Sonnet-x' THEN 200000 WHEN 'o1-preview' THEN 128000
   WHEN 'gemini-ultra' THEN 32768 WHEN 'mystery-7b' THEN 0 WHEN 'GPT-3.5-turbo-16k' THEN 16384 WHEN 'claude-next' THEN 200000 ELSE 128000 END AS BIGINT) AS max_tokens
  FROM v_usage"""


@query("resolve_model", RESOLVED)
def _(t):
    return u.resolve_model(t.usage.select("seq", "model_id"))


@query("models_by_vendor", f"SELECT DISTINCT model_id, family FROM ({RESOLVED}) WHERE vendor = 'OpenAI'")
def _(t):
    models = u.resolve_model(t.usage.select("model_id").distinct())
    return u.models_by_vendor(models, "openai").select("model_id", "family")


@query("model_vendor_summary", f"SELECT count(DISTINCT model_id) AS models, string_agg(DISTINCT vendor, ',' ORDER BY vendor) AS vendors FROM ({RESOLVED})")
def _(t):
    models = u.resolve_model(t.usage.select("model_id").distinct())
    return u.model_vendor_summary(models).withColumn("vendors", F.array_join("vendors", ","))


@query("estimate_tokens", "SELECT conv_id, turn, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", estimate_tokens(F.col("text")).alias("tokens"))


@query("usage_export_json", """SELECT 'summary' AS kind, '{"calls":' || count(*) || ',"total_tokens":' || CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) || '}' AS line FROM v_usage
  UNION ALL SELECT 'entry', '{"ts_ms":' || ts_ms || ',"model_id":"' || model_id || '","prompt_tokens":' || prompt_tokens || ',"completion_tokens":' ||
   completion_tokens || ',"total_tokens":' || prompt_tokens + completion_tokens || '}' FROM v_usage
  UNION ALL SELECT 'model', '{"model_id":"' || model_id || '","calls":' || count(*) || ',"prompt_tokens":' || CAST(sum(prompt_tokens) AS BIGINT) || ',"completion_tokens":' ||
   CAST(sum(completion_tokens) AS BIGINT) || ',"total_tokens":' || CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) || ',"avg_tokens_per_call":' || avg(prompt_tokens + completion_tokens) ||
   ',"max_tokens_in_call":' || max(prompt_tokens + completion_tokens) || ',"first_ms":' || min(ts_ms) || ',"last_ms":' || max(ts_ms) || '}' FROM v_usage GROUP BY model_id""")
def _(t):
    return u.usage_export_json(t.usage)


# ---- evaluation

WORDS = "list_distinct(list_filter(string_split_regex({0}, '\\s+'), lambda x: x <> ''))"
CLEAN = "lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'))"
SCORED = f"""SELECT *, coalesce(len(list_intersect({WORDS.format('p')}, {WORDS.format('e')})) / nullif(len({WORDS.format('e')}), 0)::DOUBLE, 0) AS overlap
  FROM (SELECT *, {CLEAN.format('predicted')} AS p, {CLEAN.format('expected')} AS e FROM v_preds)"""
BOOL = "CASE WHEN p = e THEN TRUE WHEN p = '' OR e = '' THEN FALSE WHEN contains(p, e) OR contains(e, p) THEN TRUE ELSE overlap > 0.7 END"
GRADE = "CASE WHEN p = e THEN 1.0 WHEN contains(p, e) OR contains(e, p) THEN 0.5 ELSE overlap * 0.3 END"


@query("word_overlap", f"SELECT test_case, round(overlap, 6) AS overlap FROM ({SCORED})")
def _(t):
    p, x = scoring._clean(F.col("predicted")), scoring._clean(F.col("expected"))
    return t.preds.select("test_case", F.round(scoring.word_overlap(p, x), 6).alias("overlap"))


@query("score_boolean", f"SELECT test_case, {BOOL} AS passed FROM ({SCORED})")
def _(t):
    return e.score_predictions(t.preds).select("test_case", "passed")


@query("score_graded", f"SELECT test_case, round({GRADE}, 6) AS score FROM ({SCORED})")
def _(t):
    return t.preds.select("test_case", F.round(scoring.score_graded(F.col("predicted"), F.col("expected")), 6).alias("score"))


ACC = f"count(*) AS total, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, round(count(*) FILTER (ok) / count(*)::DOUBLE, 6) AS accuracy FROM (SELECT run, {BOOL} AS ok FROM ({SCORED}))"


def _acc(df):
    return df.withColumn("accuracy", F.round("accuracy", 6))


@query("prompt_accuracy", f"SELECT {ACC}")
def _(t):
    return _acc(e.prompt_accuracy(e.score_predictions(t.preds)))


@query("compare_runs", f"SELECT run, {ACC} GROUP BY run")
def _(t):
    return _acc(e.compare_runs(e.score_predictions(t.preds)))


@query("mean_metric", f"SELECT run, round(avg({GRADE}), 6) AS score, count(*) AS n FROM ({SCORED}) GROUP BY run")
def _(t):
    return e.mean_metric(t.preds, by=["run"]).withColumn("score", F.round("score", 6))


@query("custom_metric", "SELECT run, round(avg(CASE WHEN length(predicted) >= length(expected) THEN 1.0 ELSE 0.0 END), 6) AS score, count(*) AS n FROM v_preds GROUP BY run")
def _(t):
    out = e.mean_metric(t.preds, lambda p, x: (F.length(p) >= F.length(x)).cast("int"), ["run"])
    return out.withColumn("score", F.round("score", 6))


@query("index_accuracy", "SELECT run, round(avg(CASE WHEN gold_index = CAST(pred_index AS INT) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM v_preds GROUP BY run")
def _(t):
    return e.index_accuracy(t.preds, ["run"]).withColumn("accuracy", F.round("accuracy", 6))


@query("eval_categorization", """SELECT count(*) AS n, round(avg(confidence), 6) AS avg_confidence, min(confidence) AS min_confidence, max(confidence) AS max_confidence,
  count(DISTINCT category) AS unique_categories, count(*) FILTER (confidence < 0.5) AS low_confidence,
  (SELECT string_agg(category || '=' || n, ',' ORDER BY category) FROM (SELECT category, count(*) AS n FROM v_cats GROUP BY 1)) AS distribution FROM v_cats""")
def _(t):
    out = e.eval_categorization(t.cats).withColumn("avg_confidence", F.round("avg_confidence", 6))
    pairs = F.transform(F.map_entries("distribution"), lambda p: F.concat_ws("=", p["key"], p["value"].cast("string")))
    return out.withColumn("distribution", F.array_join(F.array_sort(pairs), ","))


MATCH_EVAL = """count(*) AS n, count(content_id) AS matched, count(*) FILTER (content_id IS NULL) AS unmatched,
  round(count(content_id) / count(*)::DOUBLE, 6) AS match_rate, round(avg(similarity_score) FILTER (content_id IS NOT NULL), 6) AS avg_similarity,
  min(similarity_score) FILTER (content_id IS NOT NULL) AS min_similarity, max(similarity_score) FILTER (content_id IS NOT NULL) AS max_similarity FROM v_matchings"""


def _eval_out(df):
    for c in ("match_rate", "avg_similarity", "cat_avg_confidence"):
        if c in df.columns:
            df = df.withColumn(c, F.round(c, 6))
    return df


@query("eval_matching", f"SELECT {MATCH_EVAL}")
def _(t):
    return _eval_out(e.eval_matching(t.matchings))


@query("eval_all", f"""SELECT * FROM (SELECT {MATCH_EVAL}), (SELECT count(*) AS cat_n, round(avg(confidence), 6) AS cat_avg_confidence,
  count(DISTINCT category) AS cat_unique, count(*) FILTER (confidence < 0.5) AS cat_low_confidence
  FROM v_matchings m JOIN v_cats c ON m.content_id = c.content_id)""")
def _(t):
    return _eval_out(e.eval_all(t.matchings, t.cats))


@query("matched_categorizations", "SELECT c.id, c.content_id, c.category FROM v_matchings m JOIN v_cats c ON m.content_id = c.content_id")
def _(t):
    return e.matched_categorizations(t.matchings, t.cats).select("id", "content_id", "category")


@query("low_quality_matches", "SELECT id, similarity_score FROM v_matchings WHERE content_id IS NOT NULL AND similarity_score < 0.7")
def _(t):
    return e.low_quality_matches(t.matchings).select("id", "similarity_score")


@query("unmatched_results", "SELECT id, match_stage FROM v_matchings WHERE content_id IS NULL")
def _(t):
    return e.unmatched_results(t.matchings).select("id", "match_stage")
