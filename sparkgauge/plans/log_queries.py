"""Console, checkpoint, artifact and snapshot queries and their oracle texts."""

from pyspark.sql import functions as F

from sparkgauge.operators import artifacts as a
from sparkgauge.operators import logs as c
from sparkgauge.plans.registry import query

T0, T1 = 1704412800000, 1705708800000  # 2024-01-05 to 2024-01-20
IN_T = f"ts_ms BETWEEN {T0} AND {T1}"
BASE = ("collection_id", "seq", "level")

# ---- filters


@query("filter_pattern", "SELECT seq, contains(lower(message), 'error') AS contains_hit, message = 'Network error' AS exact_hit, "
       "regexp_matches(message, 'line [0-9]+$') AS regex_hit, contains(lower(message), '(timeout') AS broken_hit FROM v_console")
def _(t):
    df = t.console
    for name, pattern, kind in (
        ("contains_hit", "ERROR", "contains"),
        ("exact_hit", "Network error", "exact"),
        ("regex_hit", "line [0-9]+$", "regex"),
        ("broken_hit", "(timeout", "regex"),
    ):
        df = c.filter_pattern(df, pattern, kind).withColumnRenamed("matched", name)
    return df.select("seq", "contains_hit", "exact_hit", "regex_hit", "broken_hit")


@query("filter_patterns", "SELECT seq, regexp_matches(message, 'CORS|[0-9]{3}$') AS matched FROM v_console")
def _(t):
    return c.filter_patterns(t.console, ["CORS", "[0-9]{3}$"], "regex").select("seq", "matched")


@query("filter_level", "SELECT collection_id, seq, level FROM v_console WHERE level IN ('error', 'warn')")
def _(t):
    return c.filter_level(t.console, ["error", "warn"]).select(*BASE)


@query("filter_allowed", "SELECT collection_id, seq, level FROM v_console WHERE level = 'error' AND NOT (contains(lower(message), 'network') "
       "OR contains(lower(message), 'deprecated'))")
def _(t):
    return c.filter_allowed(c.filter_level(t.console, "error"), ["Network", "deprecated"]).select(*BASE)


@query("filter_forbidden", "SELECT collection_id, seq, level FROM v_console WHERE contains(lower(message), 'cors') OR contains(lower(message), 'uncaught')")
def _(t):
    return c.filter_forbidden(t.console, ["cors", "uncaught"]).select(*BASE)


@query("filter_entries", f"SELECT collection_id, seq, level FROM v_console WHERE level IN ('info', 'error') AND {IN_T} "
       "AND contains(lower(message), 'user') ORDER BY seq LIMIT 200")
def _(t):
    return c.filter_entries(t.console, ["info", "error"], T0, T1, "User", 200).select(*BASE)


@query("filter_console_regex", f"SELECT collection_id, seq, level FROM v_console WHERE {IN_T} AND regexp_matches(message, '(?i)user 1[0-9]+ DID (view|click)')")
def _(t):
    return c.filter_console_regex(t.console, None, T0, T1, "user 1[0-9]+ DID (view|click)").select(*BASE)


@query("normalize_console", """SELECT seq AS id, CASE WHEN seq % 3 = 0 THEN 'log' ELSE level END AS level, message AS text,
  strftime(make_timestamp_ms(ts_ms), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(ts_ms % 1000 AS STRING), 3, '0') || 'Z' AS timestamp,
  CASE WHEN seq % 4 <> 0 THEN url END AS source_url, seq % 4 <> 0 AS has_source FROM v_console""")
def _(t):
    i = F.col("seq")
    raw = t.console.select(
        i.alias("id"),
        F.when(i % 3 != 0, F.col("level")).alias("level"),
        F.when(i % 2 == 0, F.col("message")).alias("text"),
        "message",
        F.col("ts_ms").alias("timestamp"),
        F.lit(None).cast("string").alias("source"),
        F.when(i % 4 != 0, F.col("url")).alias("url"),
        (i % 100).alias("line"),
    )
    return c.normalize_console(raw).select(
        "id", "level", "text", "timestamp", F.col("source.url").alias("source_url"), F.col("source").isNotNull().alias("has_source")
    )


# ---- captures

CAPTURES = """SELECT collection_id, min(url) AS url, arg_min(ts_ms, seq) AS start_ms, arg_max(ts_ms, seq) AS end_ms, count(*) AS total,
  count(*) FILTER (level = 'log') AS log_count, count(*) FILTER (level = 'info') AS info_count,
  count(*) FILTER (level = 'warn') AS warn_count, count(*) FILTER (level = 'error') AS error_count,
  count(*) FILTER (level = 'debug') AS debug_count FROM v_console GROUP BY collection_id"""


@query("console_collection", CAPTURES)
def _(t):
    return c.console_collection(t.console)


@query("query_collections", f"SELECT collection_id, start_ms FROM ({CAPTURES}) WHERE end_ms >= {T0} AND start_ms <= 1704153600000 AND error_count > 0 "
       "AND warn_count > 0 ORDER BY start_ms DESC, collection_id DESC LIMIT 50")
def _(t):
    found = c.query_collections(c.console_collection(t.console), None, T0, 1704153600000, True, True, 50)
    return found.select("collection_id", "start_ms")


@query("query_by_level", f"SELECT collection_id, start_ms FROM ({CAPTURES}) WHERE debug_count > 0")
def _(t):
    return c.query_by_level(c.console_collection(t.console), "debug").select("collection_id", "start_ms")


@query("search_console", "SELECT collection_id, seq, message FROM v_console WHERE contains(lower(message), 'timeout')")
def _(t):
    return c.search_console(t.console, "TIMEOUT").select("collection_id", "seq", "message")


@query("search_console_counts", "SELECT collection_id, count(*) AS matches FROM v_console WHERE contains(lower(message), 'timeout') GROUP BY 1")
def _(t):
    return c.search_console_counts(t.console, "TIMEOUT")


# ---- summaries

CATEGORY = """CASE WHEN regexp_matches(message, '(?i)cors|cross-origin|access-control') THEN 'cors'
  WHEN regexp_matches(message, '(?i)network|fetch|xhr|ajax|request failed|timeout|connection') THEN 'network'
  WHEN regexp_matches(message, '(?i)syntax error|reference error|type error|uncaught|undefined|is not a function|cannot read property') THEN 'script'
  WHEN regexp_matches(message, '(?i)failed to load|404|not found|resource|\\.js|\\.css|\\.png|\\.jpg|\\.svg') THEN 'resource' ELSE 'other' END"""


@query("error_categories", f"SELECT {CATEGORY} AS category, count(*) AS n FROM v_console WHERE level = 'error' GROUP BY 1")
def _(t):
    return c.error_categories(t.console)


SUMMARY = """SELECT collection_id, count(*) AS total, count(*) FILTER (level = 'log') AS log_count, count(*) FILTER (level = 'info') AS info_count,
  count(*) FILTER (level = 'warn') AS warn_count, count(*) FILTER (level = 'error') AS error_count, count(*) FILTER (level = 'debug') AS debug_count,
  count(DISTINCT message) FILTER (level = 'error') AS unique_errors, count(DISTINCT message) FILTER (level = 'warn') AS unique_warnings"""


@query("console_summary", SUMMARY + "".join(
    f", count(*) FILTER (level = 'error' AND {CATEGORY} = '{k}') AS {k}_errors" for k in ("cors", "network", "script", "resource", "other")
) + " FROM v_console GROUP BY collection_id")
def _(t):
    return c.console_summary(t.console, categories=True)


@query("unique_messages", "SELECT collection_id, level, message, count(*) AS n FROM v_console WHERE level IN ('error', 'warn') GROUP BY ALL")
def _(t):
    return c.unique_messages(t.console)


@query("console_global_stats", f"""SELECT count(*) AS captures, CAST(sum(total) AS BIGINT) AS entries, CAST(sum(log_count) AS BIGINT) AS log_count,
  CAST(sum(info_count) AS BIGINT) AS info_count, CAST(sum(warn_count) AS BIGINT) AS warn_count,
  CAST(sum(error_count) AS BIGINT) AS error_count, CAST(sum(debug_count) AS BIGINT) AS debug_count FROM ({CAPTURES})""")
def _(t):
    return c.console_global_stats(c.console_collection(t.console))


@query("error_index", "SELECT collection_id, url, seq, ts_ms, message FROM v_console WHERE level = 'error'")
def _(t):
    return c.error_index(t.console)


@query("error_index_heads", f"SELECT collection_id, url, start_ms, error_count FROM ({CAPTURES}) WHERE error_count > 0")
def _(t):
    return c.error_index_heads(t.console)


# ---- checks

LIMITS = """SELECT collection_id, count(*) FILTER (level = 'error') AS e, count(*) FILTER (level = 'warn') AS w FROM v_console GROUP BY 1"""


def _limit(noun, col, n):
    return (
        f"SELECT collection_id, 'max_{noun}' AS rule, {col} <= {n} AS passed, '<= {n} {noun}' AS expected, {col} || ' {noun}' AS actual, "
        f"CASE WHEN {col} > {n} THEN 'Found ' || {col} || ' {noun}, but maximum allowed is {n}' END AS error FROM l"
    )


@query("assert_limits", f"WITH l AS ({LIMITS}) {_limit('errors', 'e', 12)} UNION ALL {_limit('warnings', 'w', 15)}")
def _(t):
    return c.assert_limits(t.console, 12, 15)


MESSAGE_RULES = [
    {"want": "expected", "text": "Network", "level": "error"},
    {"want": "expected", "text": "line 1[0-9]$", "level": "info", "match": "regex"},
    {"want": "forbidden", "text": "network error"},
    {"want": "forbidden", "text": "deprecated call", "level": "warn", "match": "exact"},
]
MESSAGE_TESTS = [
    "contains(message, 'Network') AND level = 'error'",
    "regexp_matches(message, 'line 1[0-9]$') AND level = 'info'",
    "contains(message, 'network error')",
    "message = 'deprecated call' AND level = 'warn'",
]


def _message(rule, test):
    level = rule["level"] + " " if rule.get("level") else ""
    text, want = rule["text"], rule["want"]
    name = f"{want}:{level}{text}"
    if want == "expected":
        cols = (f"m IS NOT NULL AS passed, '{text}' AS expected, coalesce(m, 'No matching {level}message found') AS actual, "
                f"CASE WHEN m IS NULL THEN 'Expected {level}message not found: \"{text}\"' END AS error")
    else:
        cols = ("m IS NULL AS passed, 'Message not found' AS expected, coalesce(m, 'No matching message found') AS actual, "
                f"CASE WHEN m IS NOT NULL THEN 'Forbidden {level}message found: \"' || m || '\"' END AS error")
    return (f"SELECT collection_id, '{name}' AS rule, {cols} FROM (SELECT collection_id, arg_min(message, seq) FILTER ({test}) AS m "
            "FROM v_console GROUP BY 1)")


@query("assert_messages", " UNION ALL ".join(_message(r, x) for r, x in zip(MESSAGE_RULES, MESSAGE_TESTS)))
def _(t):
    return c.assert_messages(t.console, MESSAGE_RULES)


@query("assertion_rollup", """WITH r AS (SELECT level, ts_ms % 2 = 0 OR seq % 10 = 4 AS passed FROM v_console)
  SELECT level, bool_and(passed) AS passed, count(*) FILTER (NOT passed) AS failed, count(*) AS total,
   CASE WHEN bool_and(passed) THEN 'passed: all ' || count(*) || ' assertions passed'
        ELSE 'failed: ' || count(*) FILTER (NOT passed) || ' of ' || count(*) || ' assertions failed' END AS message FROM r GROUP BY level""")
def _(t):
    rows = t.console.select("level", ((F.col("ts_ms") % 2 == 0) | (F.col("seq") % 10 == 4)).alias("passed"))
    return c.assertion_rollup(rows, ["level"])


@query("checkpoint_verdict", """WITH r AS (SELECT user_id, event_type AS type, value < 200 AS passed FROM events),
   f AS (SELECT user_id, string_agg(CASE n WHEN 1 THEN type ELSE type || ' x' || n END, ', ' ORDER BY type) AS types
     FROM (SELECT user_id, type, count(*) AS n FROM r WHERE NOT passed GROUP BY ALL) GROUP BY 1)
  SELECT user_id, count(*) FILTER (NOT passed) = 0 AS passed, count(*) FILTER (NOT passed) AS failed, count(*) AS total,
   CASE WHEN count(*) FILTER (NOT passed) = 0 THEN 'All ' || count(*) || ' validation(s) passed' ELSE count(*) FILTER (NOT passed) || ' of ' ||
    count(*) || ' validation(s) failed (' || any_value(types) || ')' END AS message FROM r LEFT JOIN f USING (user_id) GROUP BY 1""")
def _(t):
    rows = t.events.select("user_id", F.col("event_type").alias("type"), (F.col("value") < 200).alias("passed"))
    return c.checkpoint_verdict(rows, ["user_id"])


@query("missing_capture", "SELECT page_id AS collection_id, 'no errors' AS rule, FALSE AS passed, 'Capture not found' AS error FROM pages "
       "WHERE page_id NOT IN (SELECT user_id FROM events)")
def _(t):
    rules = t.pages.select(F.col("page_id").alias("collection_id"), F.lit("no errors").alias("rule"))
    return c.missing_capture(rules, t.console)


# ---- checkpoints


def checkpoints(t):
    pairs = F.array(
        F.struct(F.lit("a").alias("k"), F.col("custom_a").alias("v")), F.struct(F.lit("b").alias("k"), F.col("custom_b").alias("v"))
    )
    return t.checkpoints.withColumn("custom", F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())))


@query("query_checkpoints", f"SELECT id, ts_ms FROM v_checkpoints WHERE name = 'error-3' AND len(list_intersect(tags, ['smoke', 'nightly'])) > 0 AND {IN_T} "
       "AND dom_ref IS NOT NULL AND console_ref IS NOT NULL ORDER BY ts_ms DESC, id DESC LIMIT 100")
def _(t):
    return a.query_checkpoints(t.checkpoints, "error-3", None, ["smoke", "nightly"], T0, T1, ["dom", "console"], 100).select("id", "ts_ms")


@query("query_by_tag", "SELECT id, name FROM v_checkpoints WHERE list_contains(tags, 'user7')")
def _(t):
    return a.query_by_tag(t.checkpoints, "user7").select("id", "name")


@query("latest_checkpoint", "SELECT url, id, name, ts_ms FROM v_checkpoints QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts_ms DESC, id DESC) = 1")
def _(t):
    return a.latest_checkpoint(t.checkpoints, ["url"]).select("url", "id", "name", "ts_ms")


@query("checkpoint_by_name", "SELECT name, max(id) AS id FROM v_checkpoints GROUP BY name")
def _(t):
    return a.checkpoint_by_name(t.checkpoints).select("name", "id")


@query("checkpoint_history", "SELECT id, ts_ms FROM v_checkpoints WHERE url = 'https://m.ththth.example.net/en/25#top' ORDER BY ts_ms DESC, id DESC LIMIT 40")
def _(t):
    return a.checkpoint_history(t.checkpoints, "https://m.ththth.example.net/en/25#top", 40).select("id", "ts_ms")


@query("compare_checkpoints", """SELECT a.id AS a_id, b.id AS b_id, a.dom_ref IS DISTINCT FROM b.dom_ref AS dom,
  a.screenshot_ref IS DISTINCT FROM b.screenshot_ref AS screenshot, a.console_ref IS DISTINCT FROM b.console_ref AS console,
  a.network_ref IS DISTINCT FROM b.network_ref AS network,
  CASE WHEN a.custom_a IS DISTINCT FROM b.custom_a THEN 'a' ELSE '' END || CASE WHEN a.custom_b IS DISTINCT FROM b.custom_b THEN 'b' ELSE '' END AS custom
  FROM v_checkpoints a JOIN v_checkpoints b ON b.id = a.id + 1""")
def _(t):
    pairs = t.checkpoints.select(F.col("id").alias("a_id"), (F.col("id") + 1).alias("b_id"))
    return a.compare_checkpoints(pairs, checkpoints(t)).withColumn("custom", F.array_join("custom", ""))


@query("compare_captured", """SELECT a.id AS a_id, b.id AS b_id, a.dom_ref <> b.dom_ref AS dom, a.screenshot_ref <> b.screenshot_ref AS screenshot,
  a.console_ref <> b.console_ref AS console FROM v_checkpoints a JOIN v_checkpoints b ON b.id = a.id + 2""")
def _(t):
    pairs = t.checkpoints.select(F.col("id").alias("a_id"), (F.col("id") + 2).alias("b_id"))
    return a.compare_captured(pairs, checkpoints(t))


@query("key_union", """SELECT a.id AS id, concat(CASE WHEN a.custom_a IS NOT NULL OR b.custom_a IS NOT NULL THEN 'a' END,
  CASE WHEN a.custom_b IS NOT NULL OR b.custom_b IS NOT NULL THEN 'b' END) AS keys FROM v_checkpoints a JOIN v_checkpoints b ON b.id = a.id + 1""")
def _(t):
    left = checkpoints(t).select("id", F.col("custom").alias("l"))
    right = checkpoints(t).select((F.col("id") - 1).alias("id"), F.col("custom").alias("r"))
    return left.join(right, "id").select("id", F.array_join(F.array_sort(a.key_union(F.col("l"), F.col("r"))), "").alias("keys"))


@query("checkpoint_stats", "SELECT count(*) AS total, count(dom_ref) AS with_dom, count(screenshot_ref) AS with_screenshot, "
       "count(console_ref) AS with_console, min(ts_ms) AS oldest_ms, max(ts_ms) AS newest_ms FROM v_checkpoints")
def _(t):
    return a.checkpoint_stats(t.checkpoints)


@query("distinct_tags", "SELECT DISTINCT tag FROM (SELECT unnest(tags) AS tag FROM v_checkpoints) WHERE tag NOT IN ('name','url','hasScreenshot','hasDOM','hasConsole')")
def _(t):
    return a.distinct_tags(t.checkpoints)


# ---- artifacts


@query("union_artifacts", "SELECT id, category FROM v_artifacts")
def _(t):
    kinds = [t.artifacts.filter(F.col("category") == k).select("id", "category") for k in ("screenshot", "dom", "console", "network")]
    return a.union_artifacts(*kinds)


@query("artifacts_by_test", "SELECT id, path FROM v_artifacts WHERE test_id = 'src5' AND category = 'dom'")
def _(t):
    return a.artifacts_by_test(t.artifacts, "src5", "dom").select("id", "path")


@query("artifacts_in_range", "SELECT id, category FROM v_artifacts WHERE ts_ms BETWEEN 1704153600000 AND 1704499200000")
def _(t):
    return a.artifacts_in_range(t.artifacts, 1704153600000, 1704499200000).select("id", "category")


@query("recent_artifacts", "SELECT id, category FROM v_artifacts QUALIFY row_number() OVER (PARTITION BY category ORDER BY ts_ms DESC, id DESC) <= 10")
def _(t):
    return a.recent_artifacts(t.artifacts, 10).select("id", "category")


@query("find_duplicates", "SELECT category, sha256(text) AS hash, count(*) AS copies, CAST(sum(size) AS BIGINT) AS bytes, min(id) AS first_id "
       "FROM v_artifacts GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return a.find_duplicates(t.artifacts)


@query("duplicate_members", "SELECT category, sha256(text) AS hash, id, path, copies FROM "
       "(SELECT *, count(*) OVER (PARTITION BY category, text) AS copies FROM v_artifacts) WHERE copies > 1")
def _(t):
    return a.duplicate_members(t.artifacts)


@query("artifact_stats", "SELECT count(*) FILTER (category = 'screenshot') AS screenshot, count(*) FILTER (category = 'dom') AS dom, "
       "count(*) FILTER (category = 'console') AS console, count(*) FILTER (category = 'network') AS network, CAST(sum(size) AS BIGINT) AS bytes, "
       "max(ts_ms) AS last_ms FROM v_artifacts")
def _(t):
    return a.artifact_stats(t.artifacts)


RETIRE = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ts_ms DESC, id DESC) AS rn FROM v_artifacts
  WHERE category <> 'network' AND ts_ms < 1704499200000) WHERE rn > 25"""


def _retired(t):
    return a.retention_cleanup(t.artifacts, 1704499200000, 25, ["screenshot", "dom", "console"])


@query("retention_cleanup", f"SELECT id, category FROM ({RETIRE})")
def _(t):
    return _retired(t).select("id", "category")


@query("retention_stats", f"SELECT category, count(*) AS deleted, CAST(sum(size) AS BIGINT) AS freed FROM ({RETIRE}) GROUP BY 1")
def _(t):
    return a.retention_stats(_retired(t))


@query("query_screens", "SELECT id, width, height FROM v_screens WHERE url = 'https://src4.example/' AND width BETWEEN 600 AND 1500 AND height <= 900")
def _(t):
    return a.query_screens(t.screens, "https://src4.example/", width=(600, 1500), height=(None, 900)).select("id", "width", "height")


@query("query_pages", "SELECT id, ts_ms FROM v_screens WHERE ts_ms BETWEEN 1704153600000 AND 1704499200000 ORDER BY ts_ms DESC, id DESC LIMIT 60")
def _(t):
    return a.query_pages(t.screens, None, 1704153600000, 1704499200000, 60).select("id", "ts_ms")


@query("custom_validation", """SELECT id, 'small' AS name, size < 5000 AS passed, 'Custom validation "small" ' || CASE WHEN size < 5000 THEN 'passed' ELSE 'failed' END AS message,
   CASE WHEN size < 5000 THEN 'Passed' ELSE 'Failed' END AS actual FROM v_artifacts""")
def _(t):
    found = a.custom_validation(t.artifacts, F.col("size") < 5000, "small")
    return found.select("id", "name", "passed", "message", F.get("assertions", F.lit(0))["actual"].alias("actual"))


def size_check(row):
    """A user's check: one assertion, several, a plain answer or an error, by the size."""
    size = row["size"]
    if size % 4 == 0:
        return size < 5000
    if size % 4 == 1:
        return {"description": "size", "passed": size > 100, "expected": "> 100", "actual": size}
    if size % 4 == 2:
        return [{"passed": size > 10}, {"passed": row["category"] != "dom"}]
    raise ValueError(f"odd size {size}")


@query("custom_validation_results", """SELECT id, 'sizes' AS name, CASE size % 4 WHEN 0 THEN size < 5000 WHEN 1 THEN size > 100 WHEN 2 THEN size > 10 AND category <> 'dom' ELSE FALSE END AS passed,
   CASE WHEN size % 4 = 3 THEN 'Custom validation error: ValueError: odd size ' || size ELSE 'Custom validation "sizes" ' ||
     CASE WHEN CASE size % 4 WHEN 0 THEN size < 5000 WHEN 1 THEN size > 100 ELSE size > 10 AND category <> 'dom' END THEN 'passed' ELSE 'failed' END END AS message,
   CASE WHEN size % 4 = 2 THEN 2 ELSE 1 END AS n, CASE size % 4 WHEN 0 THEN CASE WHEN size < 5000 THEN 'Passed' ELSE 'Failed' END WHEN 1 THEN CAST(size AS STRING) END AS actual,
   CASE WHEN size % 4 = 3 THEN 'Failed to execute custom validation: ValueError: odd size ' || size END AS error FROM v_artifacts""")
def _(t):
    found = a.custom_validation(t.artifacts.select("id", "size", "category"), size_check, "sizes")
    first = F.get("assertions", F.lit(0))
    return found.select("id", "name", "passed", "message", F.size("assertions").alias("n"), first["actual"].alias("actual"), first["error"].alias("error"))


# ---- snapshots


def pixels(t):
    """Each 64-float vector as an 8 x 8 image."""
    p = t.embeddings.select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("p", "v"))
    v = F.abs(F.col("v").cast("double"))
    return p.select(
        "image",
        (F.col("p") % 8).alias("x"),
        F.floor(F.col("p") / 8).cast("int").alias("y"),
        *[(F.floor(v * k).cast("long") % 256).alias(n) for n, k in zip("rgb", (997, 1511, 2003))],
    )


PIX = """p AS (SELECT vec_id AS image, (pos - 1) % 8 AS x, (pos - 1) // 8 AS y, CAST(floor(abs(v::DOUBLE) * 997) AS BIGINT) % 256 AS r,
   CAST(floor(abs(v::DOUBLE) * 1511) AS BIGINT) % 256 AS g, CAST(floor(abs(v::DOUBLE) * 2003) AS BIGINT) % 256 AS b
   FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)),
  d AS (SELECT a.image AS baseline, c.image AS current, a.x, a.y, abs(a.r - c.r) + abs(a.g - c.g) + abs(a.b - c.b) > 0.3 * 765 AS different
   FROM p a JOIN p c ON c.image = a.image + 1 AND c.x = a.x AND c.y = a.y)"""


def diffs(t):
    pairs = t.embeddings.select(F.col("vec_id").alias("baseline"), (F.col("vec_id") + 1).alias("current"))
    return a.snapshot_pixels(pairs, pixels(t), 0.3)


@query("snapshot_diff", f"WITH {PIX} SELECT baseline, current, count(*) AS total, count(*) FILTER (different) AS different, "
       "floor(count(*) FILTER (different) / count(*)::DOUBLE * 100 * 100 + 0.5) / 100 AS percent FROM d GROUP BY 1, 2")
def _(t):
    return a.snapshot_diff(diffs(t))


@query("snapshot_diff_bounds", f"WITH {PIX} SELECT baseline, current, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y "
       "FROM d WHERE different GROUP BY 1, 2")
def _(t):
    return a.snapshot_diff_bounds(diffs(t))


@query("snapshot_diff_regions", f"""WITH {PIX} SELECT baseline, current, x // 3 * 3 AS x, y // 3 * 3 AS y, count(*) AS pixels,
  floor(count(*) FILTER (different) / count(*)::DOUBLE * 100 * 100 + 0.5) / 100 AS percent FROM d GROUP BY ALL
  HAVING count(*) FILTER (different) / count(*)::DOUBLE * 100 > 5""")
def _(t):
    return a.snapshot_diff_regions(diffs(t), tile=3)


# ---- test results


def results(t):
    """Orders as tests; checkpoints and validations nest by arithmetic on the key."""
    return t.orders.selectExpr(
        "CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'P' THEN 'failed' ELSE IF(o_orderkey % 2 = 0, 'skipped', 'error') END AS status",
        "CAST(floor(o_totalprice) AS BIGINT) AS duration",
        """transform(filter(sequence(0L, o_orderkey % 4), i -> i > 0), i -> named_struct(
             'status', CASE WHEN (o_orderkey + i) % 3 = 0 THEN 'passed' WHEN (o_orderkey + i) % 3 = 1 THEN 'failed' ELSE 'skipped' END,
             'validations', transform(sequence(1L, i), j -> named_struct('type', 'dom', 'passed', (o_custkey + i + j) % 5 <> 0)))) AS checkpoints""",
    )


@query("test_summary", """WITH c AS (SELECT o_orderkey, o_custkey, i FROM (SELECT *, unnest(range(1, o_orderkey % 4 + 1)) AS i FROM orders)),
  v AS (SELECT o_custkey, i, unnest(range(1, i + 1)) AS j FROM c)
  SELECT count(*) AS total_tests, count(*) FILTER (o_orderstatus = 'F') AS passed_tests, count(*) FILTER (o_orderstatus = 'P') AS failed_tests,
   count(*) FILTER (o_orderstatus = 'O' AND o_orderkey % 2 = 0) AS skipped_tests, count(*) FILTER (o_orderstatus = 'O' AND o_orderkey % 2 = 1) AS error_tests,
   CAST(sum(floor(o_totalprice)) AS BIGINT) AS total_duration,
   floor(count(*) FILTER (o_orderstatus = 'F') / count(*)::DOUBLE * 100 * 100 + 0.5) / 100 AS success_rate,
   (SELECT count(*) FROM c) AS total_checkpoints, (SELECT count(*) FROM c WHERE (o_orderkey + i) % 3 = 0) AS passed_checkpoints,
   (SELECT count(*) FROM c WHERE (o_orderkey + i) % 3 = 1) AS failed_checkpoints, (SELECT count(*) FROM v) AS total_validations,
   (SELECT count(*) FROM v WHERE (o_custkey + i + j) % 5 <> 0) AS passed_validations,
   (SELECT count(*) FROM v WHERE (o_custkey + i + j) % 5 = 0) AS failed_validations FROM orders""")
def _(t):
    return a.test_summary(results(t))
