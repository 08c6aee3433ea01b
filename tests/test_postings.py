"""Words and patterns found through postings, against direct tests."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkgauge.functions.patterns import matches_any, valid_regexes
from sparkgauge.operators import logs, postings


def test_contained_equals_direct_search(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé \n😀") for _ in range(rng.randint(0, n)))
    texts = [(i, word(40)) for i in range(200)] + [(900, None), (901, "")]
    literals = sorted({word(6) for _ in range(80)})
    got = postings.contained(spark.createDataFrame(texts, "key long, text string"), spark.createDataFrame([(x,) for x in literals], "literal string"))
    want = sorted((i, x) for i, t in texts for x in literals if t and x and x in t)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 200
    none = spark.createDataFrame([("",), (None,)], "literal string")
    assert postings.contained(spark.createDataFrame(texts, "key long, text string"), none).collect() == []


@pytest.mark.parametrize(
    "pattern, literal",
    [
        ("error", "error"), ("^GET /app.css 404$", "GET /app"), (r"app\.css", "app.css"), ("colou?r", "colo"), ("ab+cd", "ab"), ("a|b", ""),
        ("x(a|b)yz", "yz"), ("[abc]def", "def"), ("[^]]def", "def"), ("(?i)abc", ""), (r"\d+ms", "ms"), ("ab{0,3}cd", "cd"), (r"\QabX", ""), (r"a\x41b", ""),
        ("a[b[cd]e]fg", "fg"), ("(a(b)c)*d", "d"), ("", ""), ("x" + chr(92), ""),
    ],
)
def test_required_literals(pattern, literal):
    assert postings.required_literal(pattern) == literal


def test_required_literal_is_in_every_match():
    rng = random.Random(5)
    for _ in range(4000):
        pattern = "".join(rng.choice(["a", "b", "c", "ab", "(a|b)", "[ab]", "[^a]", "?", "*", "+", "{2}", "{0,1}", ".", "|", "(bc)"]) for _ in range(rng.randint(1, 7)))
        try:
            compiled = re.compile(pattern)
        except re.error:
            continue
        text = "".join(rng.choice("abc") for _ in range(12))
        found = compiled.search(text)
        if found:
            assert postings.required_literal(pattern) in found[0]


@pytest.mark.parametrize("kind", ["contains", "regex", "exact"])
def test_many_patterns_equal_the_chain(spark, kind):
    rng = random.Random(1)
    messages = [f"user {rng.randrange(300)} did {rng.choice(['Click', 'view', 'LOAD'])} at /p{rng.randrange(40)}.css?x=[{i % 7}]" for i in range(400)] + [None, "", "plain"]
    patterns = [f"user {i} d" for i in range(0, 300, 3)] + ["LOAD at /p1", "p3.css?x=[2]", "(broken", "plain", r"\d\d\d did", "^$", "Click.*p7", "a|user 7 ", "(?i)load at /p2\\."]
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(messages)], "seq long, message string")
    got = logs.filter_patterns(rows, patterns, kind)
    want = rows.withColumn("matched", F.coalesce(matches_any(F.col("message"), patterns, kind), F.lit(False)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert 0 < got.filter("matched").count() < len(messages) and got.columns == ["seq", "message", "matched"]


def test_plan_does_not_grow_with_the_patterns(spark):
    rows = spark.createDataFrame([("user 77 here",), ("nobody",)], "message string")

    def nodes(n):
        plan = logs.filter_forbidden(rows, [f"user {i} " for i in range(n)])
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        return text.count("\n"), [r[0] for r in plan.collect()]

    few, many = nodes(100), nodes(10_000)
    assert few[0] == many[0] and few[1] == many[1] == ["user 77 here"]


def test_valid_regexes_in_one_query(spark):
    assert valid_regexes(spark, ["a+", "(", "[z-a]", "x{2}", "*"]) == {"a+", "x{2}"}
