"""Rules as rows against the operators that take rules as a list, and inner markup by intervals."""

import random
import re

from pyspark.sql import functions as F

from sparkgauge.operators import logs, pages, rulesets

HTML = """<html lang=en><head><title>T &amp; t</title><style>a>b{}</style></head><body><nav class="top main"><ul id=u><li class=x>one<li data-k='a"b'>t<b>w</b>o
</ul></nav><p style="display:none">hid<br>den</p><p>5 &lt; 6&nbsp;</p><div></div></body></html>"""


def _pages(spark):
    return spark.createDataFrame([(1, HTML), (2, "<p id=q>only</p>"), (3, "")], "page_id long, html string")


def test_inner_markup_by_intervals(spark, rows):
    nodes = pages.html_nodes(_pages(spark).filter("page_id < 3"))
    got = pages.select_nodes(nodes, "ul")
    assert rows(got, "text", "html") == [("onetwo", '<li class="x">one</li><li data-k="a&quot;b">t<b>w</b>o\n</li>')]
    whole = pages.select_nodes(nodes, "html").filter("page_id = 1").collect()[0]["html"]
    assert whole.startswith("<head><title>T &amp; t</title><style>a>b{}</style></head><body><nav") and whole.endswith("hid<br>den</p><p>5 &lt; 6&nbsp;</p><div></div></body>")
    inside = {r["node_idx"]: r["html"] for r in pages.select_nodes(nodes, "*").filter("page_id = 1").collect()}
    assert len(inside) == 14 and "" in inside.values()
    assert rows(pages.select_nodes(nodes, "h6")) == []


def test_page_rules_equal_the_list_form(spark):
    rng = random.Random(2)
    frame = _pages(spark)
    nodes = pages.html_nodes(frame)
    selectors = ["p", "li", "#u", ".x", ".main", "li.x", "[lang]", "[lang=en]", "p[style]", "*", "h6", "nav.top.main", "html[lang='en']", "[data-k]", "p#q", "ul#q"]
    rules = []
    for css in selectors:
        rules += [{"kind": k, "selector": css} for k in ("exists", "notExists", "visible", "hidden")]
        rules += [{"kind": "count", "selector": css, "operator": op, "count": rng.randrange(3)} for op in rulesets.SIGNS]
        rules += [{"kind": "text", "selector": css, "text": x, "match": m} for x, m in (("one", "contains"), ("^o", "regex"), ("only", "exact"), ("(", "regex"))]
        rules += [{"kind": "attribute", "selector": css, "attribute": a, "value": v, **m} for a, v, m in (("lang", "en", {}), ("class", "o", {"match": "contains"}), ("id", "[", {"match": "regex"}))]
    want = sorted((tuple(r) for r in pages.assert_nodes(nodes, rules).collect()), key=repr)
    got = rulesets.check_pages(frame.filter("page_id < 3"), nodes, rulesets.rule_rows(spark, rules, rulesets.PAGE_RULES))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_page_rules_of_one_page_and_odd_rules(spark, rows):
    frame = _pages(spark)
    rules = [
        {"page_id": 2, "kind": "exists", "selector": "p"}, {"page_id": 9, "kind": "exists", "selector": "p"}, {"kind": "exists", "selector": "ul > li", "page_id": 1},
        {"kind": "odd", "selector": "p", "page_id": 1}, {"kind": "count", "selector": "p", "operator": "about", "count": 1, "page_id": 3}, {"kind": "exists", "selector": None, "page_id": 1},
        {"kind": "notExists", "selector": "p", "page_id": 3},
    ]
    got = rulesets.check_pages(frame, pages.html_nodes(frame), rulesets.rule_rows(spark, rules, rulesets.PAGE_RULES))
    assert rows(got, "rule", "page_id", "passed", "error") == [
        (0, 2, True, None), (1, 9, False, "Capture not found"), (2, 1, False, "Unsupported selector: ul > li"), (3, 1, False, "Unknown kind"),
        (4, 3, False, "Expected count ? 1, but got 0"), (5, 1, False, "Unsupported selector: null"), (6, 3, True, None),
    ]
    none = rulesets.rule_rows(spark, [], rulesets.PAGE_RULES)
    assert rows(rulesets.check_pages(frame, pages.html_nodes(frame), none)) == []


def _entries(spark):
    rng = random.Random(4)
    words = ["error in a.js", "Error 404", "user 7 did view", "user 8 did view", "", "slow"]
    data = [(rng.randrange(12), i, rng.choice(logs.LEVELS), rng.choice([*words, None])) for i in range(300)]
    return spark.createDataFrame(data, "collection_id long, seq long, level string, message string")


def test_log_rules_equal_the_list_form(spark):
    entries = _entries(spark)
    rules = [
        {"want": w, "text": t, **m}
        for w in ("expected", "forbidden")
        for t, m in (("error", {}), ("Error", {"level": "warn"}), (r"user \d+", {"match": "regex"}), ("slow", {"match": "exact"}), ("", {}), ("[", {"match": "regex"}), ("^$", {"match": "regex", "level": "info"}))
    ]
    want = sorted((tuple(r) for r in logs.assert_messages(entries, rules).collect()), key=repr)
    frame = rulesets.rule_rows(spark, [{"kind": r["want"], **r} for r in rules], rulesets.LOG_RULES)
    got = rulesets.check_captures(entries, frame).drop("rule")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    limits = rulesets.rule_rows(spark, [{"kind": "max_errors", "count": 4}, {"kind": "max_warnings", "count": 5}], rulesets.LOG_RULES)
    assert sorted(map(tuple, rulesets.check_captures(entries, limits).drop("rule").collect()), key=repr) == sorted(map(tuple, logs.assert_limits(entries, 4, 5).collect()), key=repr)


def test_log_rules_of_one_capture(spark, rows):
    rules = [{"collection_id": 3, "kind": "max_errors", "count": 0}, {"collection_id": 99, "kind": "expected", "text": "x"}, {"collection_id": 4, "kind": "odd"}]
    got = rulesets.check_captures(_entries(spark), rulesets.rule_rows(spark, rules, rulesets.LOG_RULES))
    assert rows(got, "rule", "collection_id", "passed") == [(0, 3, False), (1, 99, False), (2, 4, False)]


def test_plan_is_the_same_for_any_number_of_rules(spark):
    entries = _entries(spark)

    def lines(n):
        frame = rulesets.rule_rows(spark, [{"kind": "forbidden", "text": f"user {i} d"} for i in range(n)], rulesets.LOG_RULES)
        plan = rulesets.check_captures(entries, frame)
        return plan._jdf.queryExecution().optimizedPlan().toString().count("\n"), plan.filter("not passed").count()

    few, many = lines(20), lines(3000)
    assert few[0] == many[0] and few[1] == many[1] > 0


def _joins(df):
    """The keys of the left side of every join of the plan that runs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"(?:SortMergeJoin|HashJoin)(?:\(skew=true\))? \[(.*?)\], \[", plan)]


def test_rules_of_one_page_meet_only_their_page(spark, rows):
    """Each page has a rule of its own for one tag: nodes meet the rules of their page, not those of all pages."""
    frame = spark.range(40).select(F.col("id").alias("page_id"), F.expr("concat('<ul>', repeat('<li>x', int(id) % 3 + 1), '</ul>')").alias("html"))
    own = frame.selectExpr("page_id + 1000 AS rule", "page_id", "'count' AS kind", "'li' AS selector", "2L AS count")
    common = rulesets.rule_rows(spark, [{"kind": "text", "selector": "ul", "text": "xx"}], rulesets.PAGE_RULES)
    got = rulesets.check_pages(frame, pages.html_nodes(frame), common.unionByName(own, allowMissingColumns=True))
    joins = _joins(got)
    assert "page_id, key" in joins and "key" not in joins
    assert rows(got, "page_id", "rule", "passed", "actual") == sorted(
        [(i, 1000 + i, i % 3 == 1, str(i % 3 + 1)) for i in range(40)] + [(i, 0, i % 3 > 0, "x" * (i % 3 + 1)) for i in range(40)], key=repr
    )


def test_any_number_of_selector_keys(spark, rows):
    """More different keys than are listed for the index."""
    n = rulesets.FEW_KEYS + 9
    frame = spark.createDataFrame([(1, "".join(f"<p id=i{k}>{k}</p>" for k in range(0, n, 2)))], "page_id long, html string")
    rules = rulesets.rule_rows(spark, [{"kind": "exists", "selector": f"#i{k}"} for k in range(n)], rulesets.PAGE_RULES)
    assert rows(rulesets.check_pages(frame, pages.html_nodes(frame), rules), "rule", "passed") == sorted([(k, k % 2 == 0) for k in range(n)], key=repr)


def test_rules_of_one_capture_meet_only_their_capture(spark, rows):
    """Many captures ask for the same text, each in a rule of its own."""
    entries = spark.range(30).selectExpr("id AS collection_id", "id AS seq", "'error' AS level", "if(id % 2 = 0, 'slow page', 'fine') AS message")
    own = entries.selectExpr("collection_id + 100 AS rule", "collection_id", "'expected' AS kind", "'slow' AS text")
    common = rulesets.rule_rows(spark, [{"kind": "expected", "text": "fine"}], rulesets.LOG_RULES)
    got = rulesets.check_captures(entries, common.unionByName(own, allowMissingColumns=True))
    assert "pattern, match" not in _joins(got) and "collection_id, pattern, match" in _joins(got)
    assert rows(got, "collection_id", "rule", "passed") == sorted([(i, 100 + i, i % 2 == 0) for i in range(30)] + [(i, 0, i % 2 == 1) for i in range(30)], key=repr)
