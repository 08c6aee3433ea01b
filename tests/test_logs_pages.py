import pytest
from pyspark.sql import functions as F

from sparkgauge.functions.textfns import html_to_text
from sparkgauge.operators import artifacts as a
from sparkgauge.operators import logs, pages

ENTRY = "collection_id long, seq long, ts_ms long, level string, message string, url string"


@pytest.fixture(scope="module")
def entries(spark):
    data = [
        (1, 0, 10, "error", "Network error", "u"),
        (1, 1, 20, "error", "Network error", "u"),
        (1, 2, 30, "error", "Validation error", "u"),
        (2, 3, 40, "warn", "deprecated", "v"),
        (2, 4, 50, "info", "CORS is fine", "v"),
    ]
    return spark.createDataFrame(data, ENTRY)


def test_exact_contains_regex_and_broken_regex(entries):
    count = lambda p, k: logs.filter_pattern(entries, p, k).filter("matched").count()
    assert (count("Network error", "exact"), count("network ERROR", "contains")) == (2, 2)
    assert (count("^Val", "regex"), count("network [", "regex"), count("", "contains")) == (1, 0, 5)


def test_empty_lists_keep_all_or_none(entries):
    assert logs.filter_allowed(entries, []).count() == 5
    assert logs.filter_forbidden(entries, []).count() == 0


@pytest.mark.parametrize(
    "message, category",
    [("blocked by CORS: fetch", "cors"), ("XHR failed", "network"), ("Uncaught boom", "script"), ("/a.js is gone", "resource"), ("hm", "other")],
)
def test_error_category_order(spark, message, category):
    df = spark.createDataFrame([(message,)], "m string")
    assert df.select(logs.error_category(F.col("m"))).first()[0] == category


def test_message_rules_mind_the_case(entries):
    rules = [
        {"want": "expected", "level": "error", "text": "network"},
        {"want": "forbidden", "text": "CORS"},
        {"want": "expected", "level": "error", "text": "(", "match": "regex"},
    ]
    got = {(r["collection_id"], r["rule"].split(":")[0], r["expected"]): r["passed"] for r in logs.assert_messages(entries, rules).collect()}
    assert got[(1, "expected", "network")] is False
    assert got[(2, "forbidden", "Message not found")] is False and got[(1, "forbidden", "Message not found")] is True
    assert got[(1, "expected", "(")] is False


def test_verdict_lines(spark):
    data = [(1, "dom", True), (1, "dom", False), (1, "console", False), (2, "dom", True), (3, "dom", False), (3, "dom", False), (3, "a", False)]
    df = spark.createDataFrame(data, "k long, type string, passed boolean")
    got = {r["k"]: r["message"] for r in logs.checkpoint_verdict(df, ["k"]).collect()}
    assert got == {1: "2 of 3 validation(s) failed (console, dom)", 2: "All 1 validation(s) passed", 3: "3 of 3 validation(s) failed (a, dom x2)"}


PAGE = """<!doctype html><html><head><title> T &amp; x </title><style>p{}</style></head>
<body class="main wide"><!-- c --><p id=a>One<br>two <b>bold</b><p style="display: none">Gone</p>
<ul><li>1<li><a href="/x?y=1">l</a></ul><script>var s="<p>no</p>";</script><img src="i.png"></body></html>"""


@pytest.fixture(scope="module")
def page(spark):
    return spark.createDataFrame([(7, "https://h.example/d/p.html?q#f", PAGE)], "page_id long, url string, html string")


@pytest.fixture(scope="module")
def nodes(page):
    return pages.html_nodes(page).cache()


def test_node_order_and_subtrees(nodes):
    got = {r["node_idx"]: r for r in nodes.collect()}
    tags = [got[i]["tag"] for i in range(len(got))]
    assert tags[:4] == ["html", "head", "title", "#text"]
    assert tags.count("p") == 2 and tags.count("li") == 2 and tags.count("script") == 1
    body = next(r for r in got.values() if r["tag"] == "body")
    assert body["last_idx"] == len(got) - 1 and body["attributes"] == {"class": "main wide"}
    assert all(r["parent_idx"] is None or r["parent_idx"] < i <= got[r["parent_idx"]]["last_idx"] for i, r in got.items())


def test_selectors(nodes):
    count = lambda css: pages.select_nodes(nodes, css).count()
    assert [count(c) for c in ("p", "#a", "p#a", ".wide", "body.main.wide", "[style]", 'a[href="/x?y=1"]', "*", ".none")][:7] == [2, 1, 1, 1, 1, 1, 1]
    assert count(".none") == 0
    with pytest.raises(ValueError):
        pages.selector("div > p")


def test_page_checks(nodes):
    rules = [
        {"kind": "visible", "selector": "#a"},
        {"kind": "hidden", "selector": "[style]"},
        {"kind": "visible", "selector": "form"},
        {"kind": "text", "selector": "#a", "text": "Onetwo bold", "match": "exact"},
        {"kind": "text", "selector": "#a", "text": "one"},
        {"kind": "attribute", "selector": "a", "attribute": "href", "value": "/x", "match": "contains"},
        {"kind": "attribute", "selector": "a", "attribute": "id", "value": "x"},
        {"kind": "count", "selector": "li", "operator": "greaterThanOrEqual", "count": 2},
        {"kind": "notExists", "selector": "form"},
        {"kind": "text", "selector": "p", "text": "[", "match": "regex"},
    ]
    got = {r["rule"]: r for r in pages.assert_nodes(nodes, rules).collect()}
    assert [got[i]["passed"] for i in range(10)] == [True, True, False, True, False, True, False, True, True, False]
    assert got[2]["actual"] == "Element not found" and got[6]["actual"] == "Attribute not found"
    assert got[9]["error"] == "Invalid regex pattern: [" and got[0]["error"] is None


def test_links_images_text(page, nodes):
    assert pages.extract_links(page, nodes).first()["url"] == "https://h.example/x?y=1"
    assert pages.extract_images(page, nodes).first()["url"] == "https://h.example/d/i.png"
    assert pages.page_text(nodes).first()["text"] == "One\ntwo\nbold\nGone\n1\nl"


def test_html_to_text(spark):
    texts = ["<p>a</p><p>b</p>", "<script>x</script>1 &lt; 2 &amp;lt; &eacute;&nbsp; z", "a<SCRIPT>b</SCRIPT>", "&copy; &amp; R&D", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(html_to_text(F.col("t"))).collect()] == ["ab", "1 < 2 &lt; é z", "ab", "© & R&D", None]


def test_snapshot_tiles_and_bounds(spark):
    def image(name, lit):
        return [(name, x, y, 255 if (x, y) in lit else 0, 0, 0) for x in range(60) for y in range(10)]

    px = spark.createDataFrame(image("a", set()) + image("b", {(55, 1), (56, 1), (57, 2), (58, 3), (59, 4), (55, 9)}), "image string, x int, y int, r int, g int, b int")
    pairs = spark.createDataFrame([("a", "b"), ("a", "a")], "baseline string, current string")
    diff = a.snapshot_pixels(pairs, px, 0.1)
    assert {(r["current"], r["different"], r["percent"]) for r in a.snapshot_diff(diff).collect()} == {("b", 6, 1.0), ("a", 0, 0.0)}
    assert tuple(a.snapshot_diff_bounds(diff).first())[2:] == (55, 59, 1, 9)
    assert [tuple(r)[2:] for r in a.snapshot_diff_regions(diff).collect()] == [(50, 0, 100, 6.0)]


def test_user_check(spark):
    refs = spark.createDataFrame([(1, 5), (2, None)], "id long, size long")
    assert [r["passed"] for r in a.custom_validation(refs, F.col("size") > 1, "big").orderBy("id").collect()] == [True, False]

    def check(row):
        if row["size"] is None:
            raise ValueError("no size")
        return [{"passed": row["size"] > 1, "actual": row["size"]}, {"passed": True, "description": "always"}]

    got = {r["id"]: r for r in a.custom_validation(refs, check, "mine").collect()}
    assert got[1]["passed"] and got[1]["message"] == 'Custom validation "mine" passed' and [x["actual"] for x in got[1]["assertions"]] == ["5", None]
    assert not got[2]["passed"] and got[2]["message"] == "Custom validation error: ValueError: no size" and len(got[2]["assertions"]) == 1
    for found, want in ((True, True), (None, False), ({"passed": False}, False), ([], True), (3, False)):
        assert {r["passed"] for r in a.custom_validation(refs, lambda row, f=found: f, "x").collect()} == {want}


def test_resolve_url_removes_dot_segments(spark):
    from sparkgauge.operators.pages import resolve_url

    base = "https://a.org/x/y/z?q=1"
    want = {
        "../a/b": "https://a.org/x/a/b", "./c": "https://a.org/x/y/c", "../../../d": "https://a.org/d", "..": "https://a.org/x/",
        "e/./f/../g?x=../h#..": "https://a.org/x/y/e/g?x=../h#..", "/k/../l": "https://a.org/l", "m..n/o": "https://a.org/x/y/m..n/o",
        "p?u=/../v": "https://a.org/x/y/p?u=/../v", "mailto:x": "mailto:x",
    }
    links = spark.createDataFrame([(h, base) for h in want], "h string, b string")
    assert {r[0]: r[1] for r in links.select("h", resolve_url(F.col("h"), F.col("b"))).collect()} == want


def test_regex_validity_is_the_engines(spark):
    from sparkgauge.functions.patterns import is_valid_regex, matches

    assert is_valid_regex(r"\p{L}+") and not is_valid_regex("(?P<n>a)") and not is_valid_regex("(")
    texts = spark.createDataFrame([("\u00e9t\u00e9",), ("12",), ("x(?P<n>a)",)], "t string")
    assert [r[0] for r in texts.filter(matches(F.col("t"), r"^\p{L}+$", "regex")).collect()] == ["\u00e9t\u00e9"]
    assert [r[0] for r in texts.filter(matches(F.col("t"), "(?P<n>a)", "regex")).collect()] == ["x(?P<n>a)"]
