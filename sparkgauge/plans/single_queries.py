"""Queries for operators that other queries also show together."""

from pyspark.sql import functions as F

from sparkgauge.functions import levels
from sparkgauge.functions.patterns import matches
from sparkgauge.functions.timefns import diff_days, diff_hours
from sparkgauge.operators import delivery as d
from sparkgauge.operators import logs as c
from sparkgauge.operators import pages as p
from sparkgauge.operators import rules as r
from sparkgauge.operators import rulesets
from sparkgauge.plans.delivery_queries import BAND, FREQ_BAND, HOURS, _worst
from sparkgauge.plans.log_queries import LIMITS, MESSAGE_RULES, MESSAGE_TESTS, _limit, _message
from sparkgauge.plans.page_queries import CLEAN, H1, LANG, TAGS, _count, _exists, nodes, rules, LINES
from sparkgauge.plans.registry import query
from sparkgauge.sources.constraints import violations

# ---- bands over the value of every issue

BANDS = {
    "level_frequency": (levels.level_frequency, "value / 100", FREQ_BAND("value / 100")),
    "level_lead_time": (levels.level_lead_time, "value * 10", BAND("value * 10", 24, 168, 720)),
    "level_failure_rate": (levels.level_failure_rate, "value / 5", BAND("value / 5", 5, 10, 15)),
    "level_recovery": (levels.level_recovery, "value", BAND("value", 1, 24, 168)),
}


def _register_band(name):
    band, value, text = BANDS[name]

    @query(name, f"SELECT id, {text} AS level FROM v_issues")
    def _(t):
        return t.issues.select("id", band(F.expr(value)).alias("level"))


for _name in BANDS:
    _register_band(_name)

_ALL = ", ".join(f"{text} AS {name}" for name, (_, _, text) in BANDS.items())


@query("overall_level", f"SELECT id, {_worst(*BANDS)} AS level FROM (SELECT id, {_ALL} FROM v_issues)")
def _(t):
    return t.issues.select("id", levels.overall_level(*[band(F.expr(value)) for band, value, _ in BANDS.values()]).alias("level"))


@query("median", "SELECT repo, median(epoch_ms(updated_at) - epoch_ms(created_at)) / 60000 AS minutes FROM v_runs GROUP BY 1")
def _(t):
    minutes = (F.unix_millis("updated_at") - F.unix_millis("created_at")) / 60000
    return d.percentile_linear(t.runs, ["repo"], minutes, {"minutes": 0.5})


@query("mean", "SELECT repo, round(avg((epoch_ms(updated_at) - epoch_ms(created_at)) // 60000), 6) AS minutes FROM v_runs GROUP BY 1")
def _(t):
    minutes = ((F.unix_millis("updated_at") - F.unix_millis("created_at")) / 60000).cast("long")
    return t.runs.groupBy("repo").agg(F.round(d.mean_or_zero(minutes), 6).alias("minutes"))


@query("diff_hours", f"SELECT id, {HOURS('updated', 'resolved')} AS hours FROM v_issues")
def _(t):
    return t.issues.select("id", diff_hours(F.col("updated"), F.col("resolved")).alias("hours"))


@query("diff_days", "SELECT id, CAST(trunc((epoch_ms(updated) - epoch_ms(resolved)) / 86400000.0) AS BIGINT) AS days FROM v_issues")
def _(t):
    return t.issues.select("id", diff_days(F.col("updated"), F.col("resolved")).alias("days"))


# ---- log checks


def _log_rules(t, rules, own):
    """Rules for every capture, and one for each page id, which may or may not name a capture."""
    return rulesets.rule_rows(t.spark, rules, rulesets.LOG_RULES).unionByName(
        t.pages.select((F.col("page_id") + 1000).alias("rule"), F.col("page_id").alias("collection_id"), *[F.expr(v).alias(k) for k, v in own.items()])
    )


def _own_limit(noun, column):
    """SQL of the rule that each page id has of its own."""
    return f"""SELECT page_id AS collection_id, 1000 + page_id AS rule, CASE WHEN {column} IS NULL THEN 'max_{noun}' ELSE 'max_{noun}' END AS name,
     coalesce({column} <= page_id % 9, FALSE) AS passed, CASE WHEN {column} IS NULL THEN 'Capture' ELSE '<= ' || page_id % 9 || ' {noun}' END AS expected,
     CASE WHEN {column} IS NULL THEN 'Capture not found' ELSE {column} || ' {noun}' END AS actual,
     CASE WHEN {column} IS NULL THEN 'Capture not found' WHEN {column} > page_id % 9 THEN 'Found ' || {column} || ' {noun}, but maximum allowed is ' || page_id % 9 END AS error
     FROM pages LEFT JOIN l ON collection_id = page_id"""


def _common(sql, number):
    return f"SELECT collection_id, {number} AS rule, rule AS name, passed, expected, actual, error FROM ({sql})"


def _limits(t, noun):
    own = {"kind": f"'max_{noun}'", "count": "page_id % 9", "text": "string(null)", "level": "string(null)", "match": "string(null)"}
    return rulesets.check_captures(t.console, _log_rules(t, [{"kind": f"max_{noun}", "count": 10}], own))


@query("assert_max_errors", f"WITH l AS ({LIMITS}) {_common(_limit('errors', 'e', 10), 0)} UNION ALL {_own_limit('errors', 'e')}")
def _(t):
    return _limits(t, "errors")


@query("assert_max_warnings", f"WITH l AS ({LIMITS}) {_common(_limit('warnings', 'w', 10), 0)} UNION ALL {_own_limit('warnings', 'w')}")
def _(t):
    return _limits(t, "warnings")


def _own_message(want):
    """SQL of the message rule that each page id has of its own: one user's name, at any level."""
    text = "'user ' || page_id || ' did'"
    if want == "expected":
        cols = (f"m IS NOT NULL AS passed, CASE WHEN lost THEN 'Capture' ELSE {text} END AS expected, "
                "CASE WHEN lost THEN 'Capture not found' ELSE coalesce(m, 'No matching message found') END AS actual, "
                f"CASE WHEN lost THEN 'Capture not found' WHEN m IS NULL THEN 'Expected message not found: \"' || {text} || '\"' END AS error")
    else:
        cols = ("m IS NULL AND NOT lost AS passed, CASE WHEN lost THEN 'Capture' ELSE 'Message not found' END AS expected, "
                "CASE WHEN lost THEN 'Capture not found' ELSE coalesce(m, 'No matching message found') END AS actual, "
                "CASE WHEN lost THEN 'Capture not found' WHEN m IS NOT NULL THEN 'Forbidden message found: \"' || m || '\"' END AS error")
    name = f"CASE WHEN lost THEN '{want}' ELSE '{want}:' || {text} END AS name"
    return (f"SELECT page_id AS collection_id, 1000 + page_id AS rule, {name}, {cols} FROM (SELECT page_id, arg_min(message, seq) FILTER (contains(message, {text})) AS m, "
            "count(seq) = 0 AS lost FROM pages LEFT JOIN v_console ON collection_id = page_id GROUP BY 1)")


def _messages(t, want, rules):
    own = {"kind": f"'{want}'", "count": "bigint(null)", "text": "'user ' || page_id || ' did'", "level": "string(null)", "match": "string(null)"}
    rows = [{"kind": r["want"], **{k: v for k, v in r.items() if k != "want"}} for r in rules]
    return rulesets.check_captures(t.console, _log_rules(t, rows, own))


def _message_sql(want, numbers):
    parts = [_common(_message(MESSAGE_RULES[i], MESSAGE_TESTS[i]), k) for k, i in enumerate(numbers)]
    return " UNION ALL ".join([*parts, _own_message(want)])


@query("assert_expected_message", _message_sql("expected", (0, 1)))
def _(t):
    return _messages(t, "expected", MESSAGE_RULES[:2])


@query("assert_forbidden_message", _message_sql("forbidden", (2, 3)))
def _(t):
    return _messages(t, "forbidden", MESSAGE_RULES[2:])


@query("match_type_param", """SELECT seq, 'exact' AS kind FROM v_console WHERE message = 'deprecated call'
  UNION ALL SELECT seq, 'contains' FROM v_console WHERE contains(lower(message), 'load')
  UNION ALL SELECT seq, 'regex' FROM v_console WHERE regexp_matches(message, '4{1}04$')""")
def _(t):
    wanted = {"exact": "deprecated call", "contains": "LOAD", "regex": "4{1}04$"}
    kinds = [F.when(matches(F.col("message"), text, kind), F.lit(kind)) for kind, text in wanted.items()]
    return t.console.select("seq", F.explode(F.array_compact(F.array(*kinds))).alias("kind"))


@query("violations", """SELECT 'event' AS kind, CAST(seq AS STRING) AS id, 'level' AS violated FROM (SELECT seq, CASE WHEN contains(message, '404') THEN 'fatal' ELSE level END AS level FROM v_console)
   WHERE level NOT IN ('log', 'info', 'warn', 'error', 'debug')
  UNION ALL SELECT 'category', CAST(id AS STRING), 'confidence' FROM v_cats WHERE confidence * 1.2 > 1""")
def _(t):
    level = F.when(F.contains("message", F.lit("404")), "fatal").otherwise(F.col("level"))
    logs = violations(t.console.withColumn("level", level), "console_entries")
    cats = violations(t.cats.withColumn("confidence", F.col("confidence") * 1.2), "categorizations")
    parts = [(logs, "event", "seq"), (cats, "category", "id")]
    rows = [df.select(F.lit(k).alias("kind"), F.col(i).cast("string").alias("id"), F.array_join("violated", ",").alias("violated")) for df, k, i in parts]
    return rows[0].unionByName(rows[1])


# ---- page checks

OUT = ("page_id", "rule", "passed", "expected", "actual", "error")


OWN = ("li", "img", "form")  # each page has a rule of its own for one of these, by its id
OWN_TAG = "CASE page_id % 3 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(OWN)) + " END"
OWN_N = "CASE page_id % 3 " + " ".join(f"WHEN {i} THEN {TAGS(x)}" for i, x in enumerate(OWN)) + " END"


def _page_rules(t, rules, own):
    """Rules for all pages, one of its own for each page, and one for a page that is not there."""
    common = rulesets.rule_rows(t.spark, [*rules, {"rule": 999, "page_id": -1, "kind": "exists", "selector": "p"}], rulesets.PAGE_RULES)
    kinds = {f.name: f.dataType for f in common.schema}
    given = {"rule": "page_id + 1000", "page_id": "page_id", "selector": OWN_TAG, **own}
    return common.unionByName(t.pages.select(*[F.expr(given.get(c, "null")).cast(kinds[c]).alias(c) for c in common.columns]))


GONE = "SELECT -1, 999, FALSE, 'Capture', 'Capture not found', 'Capture not found'"


def _checked(t, rules, own):
    return rulesets.check_pages(t.pages, nodes(t), _page_rules(t, rules, own)).select(*OUT)


def _own_exists(want):
    passed, kind = ("n > 0", "Element exists") if want else ("n = 0", "Element does not exist")
    why = "not found in DOM" if want else "found in DOM but should not exist"
    return (f"SELECT page_id, 1000 + page_id AS rule, {passed} AS passed, '{kind}' AS expected, CASE WHEN n > 0 THEN 'Found ' || n || ' element(s)' "
            f"ELSE 'Element not found' END AS actual, CASE WHEN NOT ({passed}) THEN 'Element \"' || tag || '\" {why}' END AS error "
            f"FROM (SELECT page_id, {OWN_N} AS n, {OWN_TAG} AS tag FROM pages)")


@query("assert_exists", f"{_exists(0, 'article', TAGS('article'), True)} UNION ALL {_own_exists(True)} UNION ALL {GONE}")
def _(t):
    return _checked(t, [{"kind": "exists", "selector": "article"}], {"kind": "'exists'"})


@query("assert_not_exists", f"{_exists(0, 'br', TAGS('br'), False)} UNION ALL {_own_exists(False)} UNION ALL {GONE}")
def _(t):
    return _checked(t, [{"kind": "notExists", "selector": "br"}], {"kind": "'notExists'"})


OWN_COUNT = f"""SELECT page_id, 1000 + page_id AS rule, n > page_id % 4 AS passed, '> ' || page_id % 4 AS expected, CAST(n AS STRING) AS actual,
  CASE WHEN n <= page_id % 4 THEN 'Expected count > ' || page_id % 4 || ', but got ' || n END AS error FROM (SELECT page_id, {OWN_N} AS n FROM pages)"""


@query("assert_count", f"{_count(0, TAGS('li'), '>=', 6)} UNION ALL {_count(1, TAGS('br'), '<', 2)} UNION ALL {OWN_COUNT} UNION ALL {GONE}")
def _(t):
    counts = [
        {"kind": "count", "selector": "li", "operator": "greaterThanOrEqual", "count": 6},
        {"kind": "count", "selector": "br", "operator": "lessThan", "count": 2},
    ]
    return _checked(t, counts, {"kind": "'count'", "operator": "'greaterThan'", "count": "page_id % 4"})


# pages with a long heading get a hidden navigation bar
STYLED = f"length({H1}) > 60"


def _styled(t):
    h1 = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    plain = F.regexp_replace(F.replace(h1, F.lit("&quot;"), F.lit('"')), "&amp;?", "&")
    hidden = F.replace(F.col("html"), F.lit("<nav>"), F.lit('<nav style="color:red; display: none">'))
    return p.html_nodes(t.pages.withColumn("html", F.when(F.length(F.trim(plain)) > 60, hidden).otherwise(F.col("html"))))


def _shown(kind, other):
    """Results of a visible or hidden rule for all pages and of one for the first half of them."""
    passed = STYLED if kind == "hidden" else f"NOT ({STYLED})"
    wrong = "is visible but should be hidden" if kind == "hidden" else "is hidden"
    one = (f"SELECT page_id, {{0}} AS rule, {passed} AS passed, 'Element is {kind}' AS expected, CASE WHEN {STYLED} THEN 'Element is hidden' ELSE 'Element is visible' END AS actual, "
           f"CASE WHEN NOT ({passed}) THEN 'Element \"nav\" {wrong}' END AS error FROM pages")
    return f"{one.format(0)} UNION ALL {one.format('1000 + page_id')} UNION ALL {GONE}"


def _seen(t, kind):
    rules = _page_rules(t, [{"kind": kind, "selector": "nav"}], {"kind": f"'{kind}'", "selector": "'nav'"})
    return rulesets.check_pages(t.pages, _styled(t), rules).select(*OUT)


@query("assert_visible", _shown("visible", "hidden"))
def _(t):
    return _seen(t, "visible")


@query("assert_hidden", _shown("hidden", "visible"))
def _(t):
    return _seen(t, "hidden")


PLAIN = "trim(regexp_replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '\"'), '&amp;?', '&', 'g'))"
HOST = "regexp_extract(url, '//([a-z]+)', 1)"


def _says(number, passed, wanted, actual, error):
    return f"SELECT page_id, {number} AS rule, {passed} AS passed, {wanted} AS expected, {actual} AS actual, CASE WHEN NOT ({passed}) THEN {error} END AS error FROM pages"


@query("assert_text", " UNION ALL ".join([
    _says(0, f"contains({H1}, 'the')", "'the'", H1, "'Text mismatch for \"h1\"'"),
    _says(1, f"regexp_matches({H1}, '^[A-M]')", "'^[A-M]'", H1, "'Text mismatch for \"h1\"'"),
    _says(2, "FALSE", "'('", H1, "'Invalid regex pattern: ('"),
    _says("1000 + page_id", f"contains({PLAIN}, {HOST})", HOST, PLAIN, "'Text mismatch for \"title\"'"), GONE]))
def _(t):
    h1 = {"kind": "text", "selector": "h1"}
    own = {"kind": "'text'", "selector": "'title'", "text": HOST}
    return _checked(t, [{**h1, "text": "the"}, {**h1, "text": "^[A-M]", "match": "regex"}, {**h1, "text": "(", "match": "regex"}], own)


HREF = f"regexp_replace(regexp_extract({CLEAN}, '<a href=\"([^\"]*)\"', 1), '&amp;?', '&', 'g')"
OWN_HREF = "'/' || chr(CAST(97 + page_id % 26 AS INT))"


@query("assert_attribute", " UNION ALL ".join([
    _says(0, f"{LANG} = 'en'", "'en'", LANG, "'Attribute value mismatch for \"html\"'"),
    _says(1, f"regexp_matches({LANG}, '^(fr|de)$')", "'^(fr|de)$'", LANG, "'Attribute value mismatch for \"html\"'"),
    _says(2, "FALSE", "'x'", "'Attribute not found'", "'Attribute \"id\" not found on element \"html\"'"),
    _says("1000 + page_id", f"{HREF} <> '' AND contains({HREF}, {OWN_HREF})", OWN_HREF, f"CASE WHEN {HREF} = '' THEN 'Element not found' ELSE {HREF} END",
          f"CASE WHEN {HREF} = '' THEN 'Element \"a[href]\" not found in DOM' ELSE 'Attribute value mismatch for \"a[href]\"' END"), GONE]))
def _(t):
    lang = {"kind": "attribute", "selector": "html", "attribute": "lang"}
    rows = [{**lang, "value": "en"}, {**lang, "value": "^(fr|de)$", "match": "regex"}, {**lang, "attribute": "id", "value": "x"}]
    own = {"kind": "'attribute'", "selector": "'a[href]'", "attribute": "'href'", "value": OWN_HREF, "match": "'contains'"}
    return _checked(t, rows, own)


# ---- response checks


@query("check_not_command", f"""WITH {LINES} SELECT doc_id, rule_id, NOT (len(list_filter(commands, lambda s: contains(s, 'make build') OR contains(s, 'make'))) > 0
   OR contains(low, 'make build') OR (contains(low, 'make') AND contains(low, 'build'))) AS passed FROM ru""")
def _(t):
    return rules(t).select("doc_id", "rule_id", r.check_not_command(F.col("description"), F.lit("make build")).alias("passed"))
