import random
from difflib import SequenceMatcher

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkgauge.functions.scoring import index_score, score_boolean, score_graded
from sparkgauge.functions.textfns import taxonomy_text
from sparkgauge.operators import matching as m
from sparkgauge.operators import rules as r
from sparkgauge.sources import files, tablework

VEC = "id long, vector array<double>"


def test_best_match_keeps_the_score_of_a_miss(spark, rows):
    tax = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], VEC)
    con = spark.createDataFrame([(5, [1.0, 0.1]), (6, [1.0, 1.0])], VEC)
    got = {x["taxonomy_id"]: x for x in m.best_match(tax, con, 0.9).collect()}
    assert (got[1]["content_id"], got[1]["match_stage"]) == (5, "semantic_matched")
    assert got[2]["content_id"] is None and round(got[2]["similarity_score"], 4) == 0.8536
    assert {x["similarity_score"] for x in m.match_all(tax, con, 0.9).filter("content_id is null").collect()} == {0.0}
    empty = m.best_match(tax, con.filter("false"), 0.9)
    assert rows(empty, "taxonomy_id", "similarity_score", "match_stage") == [(1, 0.0, "needs_human_review"), (2, 0.0, "needs_human_review")]
    ranks = m.rank_matches(tax, con, 2)
    assert rows(ranks, "taxonomy_id", "content_id", "rank") == [(1, 5, 1), (1, 6, 2), (2, 5, 2), (2, 6, 1)]


def test_unmatched_taxonomy_uses_the_best_row(spark, rows):
    tax = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    mat = spark.createDataFrame(
        [(1, "a", 9, 0.9), (2, "a", 8, 0.1), (3, "b", None, 0.95), (4, "c", 7, 0.5)],
        "id long, taxonomy_id string, content_id long, similarity_score double",
    )
    assert rows(m.unmatched_taxonomy(tax, mat, 0.85)) == [("b",), ("c",), ("d",)]


def test_keyword_candidate_first_best_wins(spark, rows):
    data = [("t1", "Cars", ["wheel"]), ("t2", "Food", ["soup", "x"]), ("t3", "None", []), ("t4", None, None), ("t5", "", ["", None, "x", "x"])]
    tax = spark.createDataFrame(data, "id string, category string, keywords array<string>")
    con = spark.createDataFrame(
        [("1", "A wheel", "cars here"), ("2", "Cars wheel", ""), ("3", "soup", "soup of food"), ("4", "", ""), ("5", None, None), ("6", "A wheel", "cars here")],
        "id string, title string, content string",
    )
    got = m.keyword_best_candidate(tax, con)
    assert rows(got) == [("t1", "1", 3.0), ("t2", "3", 3.5), ("t3", "1", 0.0), ("t4", "1", 0.0), ("t5", "1", 3.5)]
    assert rows(m.keyword_best_candidate(tax.limit(1), con, head=3)) == [("t1", "2", 3.0)]
    assert rows(m.keyword_best_candidate(tax, con.limit(0))) == [] and rows(m.keyword_best_candidate(tax.limit(0), con)) == []


def test_keyword_candidate_equals_brute_force(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abC d") for _ in range(rng.randint(1, n)))
    tax = [(f"t{i}", word(6), [word(7) for _ in range(rng.randint(0, 4))]) for i in range(40)]
    con = [(i, word(9), word(60)) for i in range(150)]
    want = {}
    for t, category, keys in tax:
        scores = []
        for i, title, body in con:
            title, body, c = title.lower(), body.lower(), category.lower()
            s = 2.0 * (c in title or c in body) + sum((k.lower() in title) + 0.5 * (k.lower() in body) for k in keys)
            scores.append((-s, i))
        want[t] = (min(scores)[1], -min(scores)[0])
    got = m.keyword_best_candidate(
        spark.createDataFrame(tax, "id string, category string, keywords array<string>"), spark.createDataFrame(con, "id long, title string, content string")
    )
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == want


def test_dataset_is_whole_distinct_and_repeatable(spark, rows):
    tax = spark.createDataFrame([(f"t{i}", f"cat{i}", "d", ["k"]) for i in range(3)], "id string, category string, description string, keywords array<string>")
    con = spark.range(40).select("id", F.concat(F.lit("k title "), "id").alias("title"), F.lit("u").alias("url"), F.lit("body").alias("content"))
    got = m.build_dataset(tax, con, 11)
    assert {k: n for k, n in rows(got.groupBy("taxonomy_id").count())} == {"t0": 4, "t1": 4, "t2": 3}
    for x in got.collect():
        assert 5 <= len(x["candidates"]) == len(set(x["candidates"])) <= 10
        assert x["best_match_index"] == 0 and x["content_summaries"].count("Title:") == len(x["candidates"])
    assert rows(got) == rows(m.build_dataset(tax, con, 11))
    with pytest.raises(ValueError):
        m.build_dataset(tax, con.limit(9), 3)


def test_upserts(spark, rows):
    target = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "url string, v int, seq int")
    new = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 1)], "url string, v int, seq int")
    assert rows(tablework.upsert_by_url(target, new), "url", "v") == [("a", 1), ("b", 3), ("c", 4)]
    cols = "id long, taxonomy_id string, content_id long, created_ms long"
    one = spark.createDataFrame([(1, "t", None, 1), (2, "t", 5, 1)], cols)
    two = spark.createDataFrame([(3, "t", None, 2)], cols)
    assert rows(tablework.upsert_matching(one, two), "id") == [(2,), (3,)]


def test_clear_without_filters_deletes_all(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None)], "taxonomy_id string, match_stage string")
    kept, gone = tablework.clear_matching(df)
    assert (kept.count(), gone.count()) == (0, 2)
    kept, gone = tablework.clear_matching(df, stages=["x"])
    assert (kept.count(), gone.count()) == (1, 1)


def test_files(spark, tmp_path, rows):
    path = tmp_path / "tax.csv"
    path.write_text('url,category,description,keywords\nhttps://a,"A, b",d," x ; ;y"\nnot a url,B,d,\nhttps://c,C,,\n')
    good, bad = files.load_taxonomy(spark, str(path))
    assert rows(good, "url", "category", "keywords") == [("https://a", "A, b", ["x", "y"]), ("https://c", "C", [])]
    assert bad.count() == 1
    with pytest.raises(ValueError):
        files.url_list(spark, str(write(tmp_path / "u.csv", "link\nx\n")))
    assert rows(files.url_list(spark, str(write(tmp_path / "v.csv", "url\n https://a \n  \n")))) == [("https://a",)]
    lines = spark.createDataFrame([("{bad",), ('{"custom_id":"1","response":{"body":{"choices":[{"message":{"content":"{\\"category\\":\\"A\\",\\"confidence\\":0.5}"}}]}}}',)], "value string")
    kept, lost = files.parse_batch_results(lines, "b")
    assert rows(kept) == [("1", "A", 0.5, "b")] and lost.count() == 1
    with pytest.raises(ValueError):
        files.load_examples(spark, str(write(tmp_path / "e.csv", "a,b\n1,2\n")))
    (tmp_path / "src" / "build").mkdir(parents=True)
    for name in ("src/a.py", "src/b.exe", "src/build/c.py", "src/README.md"):
        write(tmp_path / name, "x")
    found = files.select_source_files(spark, str(tmp_path / "src"))
    assert sorted(x["path"].rsplit("/", 1)[1] for x in found.collect()) == ["README.md", "a.py"]


def write(path, text):
    path.write_text(text)
    return path


def test_chunks_overlap(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(960)))), (2, "  "), (3, "a b")], "doc_id long, text string")
    got = [(x["doc_id"], x["chunk"], x["tokens"], x["text"].split()[0]) for x in files.chunk_text(df).orderBy("doc_id", "chunk").collect()]
    assert got == [(1, 0, 500, "0"), (1, 1, 500, "450"), (1, 2, 60, "900"), (3, 0, 2, "a")]


def test_taxonomy_text(spark):
    df = spark.createDataFrame([("A", "d", ["x", "y"]), ("B", "e", [])], "c string, d string, k array<string>")
    got = [x[0] for x in df.select(taxonomy_text(F.col("c"), F.col("d"), F.col("k"))).collect()]
    assert got == ["Category: A\nDescription: d\nKeywords: x, y", "Category: B\nDescription: e"]


@pytest.mark.parametrize(
    "pred, gold, ok, grade",
    [
        (" Yes ", "yes", True, 1.0),
        ("", "yes", False, 0.5),
        ("yes indeed", "yes", True, 0.5),
        ("a b c d", "d c b e", True, 0.225),
        ("a b", "c d", False, 0.0),
    ],
)
def test_scores(spark, pred, gold, ok, grade):
    df = spark.createDataFrame([(pred, gold)], "p string, g string")
    row = df.select(score_boolean(F.col("p"), F.col("g")), score_graded(F.col("p"), F.col("g"))).first()
    assert row[0] is ok and row[1] == pytest.approx(grade)


def test_index_score_is_zero_or_one(spark):
    df = spark.createDataFrame([("1", "1", 0.9), ("1", "2", 0.9), ("1", "x", 0.1)], "g string, p string, c double")
    assert [x[0] for x in df.select(index_score(F.col("g"), F.col("p"), F.col("c"))).collect()] == [1.0, 0.0, 0.0]


DOC = """before - ignored
# Dev Setup
- **Always run `npm test`** before pushing
* Never run `npm run build` by hand, ever.
1. Prefer `pnpm` over others
plain text
####### not a heading
## Docs
- Comment the code well
- short
- Don't panic in production, please
"""


def test_rule_mining(spark):
    docs = spark.createDataFrame([(1, DOC)], "doc_id long, text string")
    lines = r.rule_lines(docs)
    assert [(x["section"], x["level"]) for x in lines.orderBy("section_no", "line_no").collect()] == [("Dev Setup", 1)] * 3 + [("Docs", 2)] * 3
    rules = {x["description"]: x for x in r.make_rules(r.analyze_rule(lines)).collect()}
    must = rules["Always run `npm test` before pushing"]
    assert (must["type"], must["priority"], must["test_type"]) == ("command_requirement", "high", "command_check")
    assert must["rule_id"].startswith("devsetup_") and len(must["rule_id"]) == len("devsetup_") + 32 and must["short_id"] == must["rule_id"][:17]
    never = rules["Never run `npm run build` by hand, ever."]
    assert never["type"] == "command_prohibition" and never["negative_rules"] == ["run `npm run build` by hand"]
    assert never["expected_behavior"]["should_not_execute"] == ["npm run build"]
    assert rules["Don't panic in production, please"]["type"] == "behavior_prohibition"
    assert len(rules) == 4
    scenarios = {x["type"]: x for x in r.scenarios_from_rules(r.make_rules(r.analyze_rule(lines))).collect()}
    assert scenarios["positive"]["prompt"].startswith("I want to run the test suite")
    assert scenarios["negative"]["prompt"] == r.BUILD_PROMPT and scenarios["preference"]["prompt"] == r.MANAGER_PROMPT
    assert scenarios["general"]["prompt"] == "What should I know about: Don't panic in production, please?"


def test_response_checks(spark):
    none = []
    scenarios = spark.createDataFrame(
        [
            ("s1", "r1", (["npm test"], none, ["npm test"], none), 1, 1, 1),
            ("s2", "r2", (none, ["make build"], none, ["make build"]), 1, 1, 2),
            ("s3", "r3", (none, none, none, none), 1, 1, 3),
        ],
        "scenario_id string, rule_id string, expected_behavior struct<should_contain:array<string>,should_not_contain:array<string>,"
        "should_execute:array<string>,should_not_execute:array<string>>, doc_id long, section_no int, line_no int",
    )
    results = spark.createDataFrame(
        [
            ("a", "s1", True, "Use `npm test` now"),
            ("b", "s1", True, "use npm tests"),
            ("c", "s1", True, "nothing here"),
            ("d", "s2", True, "just make it"),
            ("e", "s2", True, "Make build works"),
            ("f", "s3", True, "x"),
            ("g", "s3", False, "x"),
            ("h", "zz", True, "x"),
            ("i", "s2", False, "nothing"),
            ("j", "s1", None, "Use `npm test` now"),
            ("k", "s1", True, "Use NPM TEST now"),
        ],
        "result_id string, scenario_id string, success boolean, response string",
    )
    out = r.result_checks(r.response_checks(r.result_scenarios(results, scenarios)))
    got = {x["result_id"]: x for x in out.collect()}
    assert {k: v["passed"] for k, v in got.items()} == {"a": True, "b": True, "c": False, "d": True, "e": False, "f": True, "g": False, "h": False, "i": False, "j": False, "k": True}
    assert [got[k]["total"] for k in "ij"] == [0, 0] and got["j"]["reason"] == "Test execution failed"
    strict = r.response_checks(r.result_scenarios(results, scenarios), case_sensitive=True, min_confidence=0.99)
    strict = {x["result_id"]: x["passed"] for x in r.result_checks(strict).collect()}
    assert strict["a"] and strict["b"] and not strict["k"]
    assert got["a"]["confidence"] == 1.0 and got["b"]["confidence"] == pytest.approx(0.95)
    assert (got["f"]["total"], got["f"]["confidence"]) == (0, 1.0)
    assert got["g"]["reason"] == "Test execution failed" and got["h"]["reason"] == "Scenario not found"


@settings(max_examples=150, deadline=None)
@given(st.text("abc ", min_size=1, max_size=70), st.text("abcd ", max_size=120))
def test_fuzzy_ratio_equals_trying_every_window(target, text):
    ratios = [SequenceMatcher(None, target, text[i : i + len(target)]).ratio() for i in range(len(text) - len(target) + 1)]
    if len(target) < 50:
        ratios.append(SequenceMatcher(None, target, text).ratio())
    assert r._best_ratio(target, text) == max(ratios, default=0.0)


@settings(max_examples=60, deadline=None)
@given(st.text("abcé ", min_size=1, max_size=70), st.lists(st.text("abcdé ", max_size=90), max_size=5))
def test_fuzzy_ratios_of_many_texts_equal_those_of_each(target, texts):
    """One pass over joined texts never takes a window that reaches into the next text."""
    want = [r._best_ratio(target, x) for x in texts]
    assert r._best_ratios(target, texts) == want
    wide = [SequenceMatcher(None, target, x[i : i + len(target)]).ratio() for x in texts for i in range(len(x) - len(target) + 1)]
    assert max(want, default=0.0) >= max(wide, default=0.0)


def test_fuzzy_ratio_takes_targets_in_turn_and_nulls():
    rows = [("npm run", "run npm"), (None, "x"), ("npm", None), ("", ""), ("npm run", "npm-run dev"), ("x" * 70, "x" * 69 + "yx")]
    got = r.fuzzy_ratio.func(pd.Series([a for a, _ in rows]), pd.Series([b for _, b in rows]))
    assert [None if pd.isna(x) else x for x in got] == [None if a is None or b is None else r._best_ratio(a, b) for a, b in rows]
