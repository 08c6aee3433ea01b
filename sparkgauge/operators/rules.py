"""Rules in markdown, test scenarios, response checks, pass rates and consistency."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sparkgauge.functions.textfns import strip_space

# Words that decide the type of a rule. Later types overwrite earlier ones.
REQUIREMENT_WORDS = ["always", "must", "should", "run"]
PROHIBITION_WORDS = ["never", "don't", "do not", "avoid"]
PREFERENCE_WORDS = ["prefer", "use", "choose"]
STRUCTURE_WORDS = ["place", "organize", "structure"]
DOCUMENTATION_WORDS = ["document", "comment", "jsdoc"]
STYLE_WORDS = ["format", "style", "convention"]
KEYWORDS = ["always", "never", "must", "should", "prefer", "use", "avoid", "run", "execute", "create", "update"]
ACTIONS = ["run", "use", "create", "update", "install", "test", "build", "commit", "push"]
UNTESTABLE_TYPES = ["documentation", "code_style", "file_structure"]  # unless they name a command
CHECK_KINDS = ["should_contain", "should_not_contain", "should_execute", "should_not_execute"]
CONSISTENT_SHARE = 0.8
MIN_CONFIDENCE = 0.7

# Prompt texts by the command a rule names, in order.
REQUIREMENT_PROMPTS = [
    (["dev", "start"], "I need to start the development server for this project. What command should I run?"),
    (["test"], "I want to run the test suite. What's the command to execute tests?"),
    (["build"], "I need to build the project for production. What command should I use?"),
    (["lint"], "I want to check the code style and quality. What command should I run?"),
    (["install"], "I need to install dependencies for this project. What command should I use?"),
    (["commit", "push"], "I've made changes and want to save them to git. What should I do?"),
]
BUILD_PROMPT = "I'm working on the project interactively. Should I run a build command?"
PACKAGE_PROMPT = "I need to add a new package. What's the best way to do that?"
MANAGER_PROMPT = "I need to install a new package. Which package manager should I use?"
LANGUAGE_PROMPT = "I'm creating a new component. Should I use JavaScript or TypeScript?"
QUOTE_PROMPT = "What style conventions should I follow for strings in JavaScript?"


def has_any(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


# ---- mining

HEADING = r"^(#{1,6})[^\S\n]+([^\n]+)"
BOLD = r"^\s*[-*]\s+\*\*(.+?)\*\*(.*)$"
BULLET = r"^\s*[-*]\s+(.+)$"
NUMBERED = r"^\s*\d+\.\s+(.+)$"


def rule_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, section, level, section_no, line_no, text) of every rule line.

    A rule line is a bullet in bold, a plain bullet or a numbered item below a heading.
    The text is cut at its headings first, so each line knows its section without a window
    and nothing is shuffled.
    """
    sections = F.split("text", r"(?m)(?=^#{1,6}[^\S\n]+[^\n])")
    headed = docs.select("doc_id", F.posexplode(sections).alias("section_no", "_s")).filter(F.col("_s").rlike(HEADING))
    # text is taken inside the array, so it leaves the generator as a plain column
    lines = F.transform(F.split("_s", "\n"), lambda x, i: F.struct(i.alias("line_no"), _rule_text(x).alias("text")))
    ruled = headed.select(
        "doc_id",
        "section_no",
        strip_space(F.regexp_extract("_s", HEADING, 2)).alias("section"),
        F.length(F.regexp_extract("_s", HEADING, 1)).alias("level"),
        F.inline(lines),
    )
    ruled = ruled.filter((F.col("line_no") > 0) & F.col("text").isNotNull())
    return ruled.select("doc_id", "section", "level", "section_no", "line_no", "text")


def _rule_text(line: Column) -> Column:
    text = (
        F.when(line.rlike(BOLD), F.concat(F.regexp_extract(line, BOLD, 1), F.regexp_extract(line, BOLD, 2)))
        .when(line.rlike(BULLET), F.regexp_extract(line, BULLET, 1))
        .when(line.rlike(NUMBERED), F.regexp_extract(line, NUMBERED, 1))
    )
    return strip_space(text)


def _settled(df: DataFrame, *columns: Column) -> DataFrame:
    """Add columns through a one-row generator. Spark then computes them once; as plain
    projections it would copy their long CASE chains into every later use."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def commands_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("`([^`]+)`"), F.lit(1))


def analyze_rule(lines: DataFrame) -> DataFrame:
    """Add commands, type, priority and keywords. The last matching type wins."""
    low = F.lower("text")
    named = F.size("commands") > 0
    kind = (
        F.when(has_any(low, STYLE_WORDS), "code_style")
        .when(has_any(low, DOCUMENTATION_WORDS), "documentation")
        .when(has_any(low, STRUCTURE_WORDS), "file_structure")
        .when(has_any(low, PREFERENCE_WORDS), "preference")
        .when(has_any(low, PROHIBITION_WORDS) & named, "command_prohibition")
        .when(has_any(low, PROHIBITION_WORDS), "behavior_prohibition")
        .when(has_any(low, REQUIREMENT_WORDS) & named, "command_requirement")
        .otherwise("unknown")
    )
    words = F.filter(F.array(*[F.lit(k) for k in KEYWORDS]), lambda k: F.contains(low, k))
    typed = _settled(lines.withColumn("commands", commands_in(F.col("text"))), kind.alias("type"), words.alias("keywords"))
    priority = (
        F.when(F.col("type").isin("code_style", "file_structure"), "low")
        .when(F.col("type").isin("command_requirement", "command_prohibition"), "high")
        .otherwise("medium")
    )
    return typed.withColumn("priority", priority)


def rule_test_type(kind: Column) -> Column:
    return (
        F.when(kind.isin("command_requirement", "command_prohibition"), "command_check")
        .when(kind == "preference", "preference_check")
        .when(kind == "workflow", "workflow_check")
        .when(kind.isin("code_style", "documentation"), "code_analysis")
        .otherwise("general_check")
    )


def rule_expectations(kind: Column, commands: Column) -> Column:
    """What a response should and should not contain or execute."""
    none = F.array().cast("array<string>")

    def given(*kinds: str) -> Column:
        return F.when(kind.isin(*kinds), commands).otherwise(none)

    return F.struct(
        given("command_requirement", "preference").alias("should_contain"),
        given("command_prohibition").alias("should_not_contain"),
        given("command_requirement").alias("should_execute"),
        given("command_prohibition").alias("should_not_execute"),
    )


def negative_phrases(text: Column) -> Column:
    """What follows never, don't, do not and avoid, up to a comma or full stop."""
    low = F.lower(text)
    found = [F.regexp_extract_all(low, F.lit(rf"{w}\s+([^,.]+)"), F.lit(1)) for w in PROHIBITION_WORDS]
    return F.transform(F.concat(*found), strip_space)


def make_rules(analyzed: DataFrame) -> DataFrame:
    """Testable rules of at least ten characters with a stable id.

    ``rule_id`` ends in the whole digest of section and text, so different rules never
    share it; ``short_id``, with eight digits of it, is for display.
    """
    prefix = F.substring(F.regexp_replace(F.lower("section"), "[^a-z0-9]", ""), 1, 10)
    digest = F.md5(F.concat_ws(":", "section", "text"))
    testable = (F.size("commands") > 0) | ~F.col("type").isin(*UNTESTABLE_TYPES)
    kept = analyzed.filter((F.length("text") >= 10) & testable)
    ids = [F.concat_ws("_", prefix, digest).alias("rule_id"), F.concat_ws("_", prefix, F.substring(digest, 1, 8)).alias("short_id")]
    return _settled(kept, *ids).select(
        "doc_id",
        "section_no",
        "line_no",
        "rule_id",
        "short_id",
        "section",
        F.col("text").alias("description"),
        "type",
        "priority",
        "commands",
        "keywords",
        rule_test_type(F.col("type")).alias("test_type"),
        rule_expectations(F.col("type"), F.col("commands")).alias("expected_behavior"),
        negative_phrases(F.col("text")).alias("negative_rules"),
    )


def rules_by(rules: DataFrame, priorities: Sequence[str] | None = None, types: Sequence[str] | None = None) -> DataFrame:
    if priorities is not None:
        rules = rules.filter(F.col("priority").isin(list(priorities)))
    return rules.filter(F.col("type").isin(list(types))) if types is not None else rules


def rule_summary(rules: DataFrame) -> DataFrame:
    """Counts by type, by priority and in total, as grouping sets of one pass."""
    sets = rules.groupingSets([["type"], ["priority"], []], "type", "priority")
    return sets.agg(F.count("*").alias("rules"))


# ---- scenarios


def _action(description: Column) -> Column:
    """First action word with what follows it, else the first five words."""
    low = F.lower(description)
    phrases = [strip_space(F.nullif(F.regexp_extract(low, rf"{a}\s+[^,.]+", 0), F.lit(""))) for a in ACTIONS]
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    return F.coalesce(*phrases, F.array_join(F.slice(words, 1, 5), " "))


def _scenario_id(kind: str, at: Column) -> Column:
    """Of one command (``at`` counts from 0) of one rule line: equal rules at two places have scenarios of their own."""
    place = F.concat_ws(":", "rule_id", F.lit(kind), "doc_id", "section_no", "line_no", at)
    return F.concat_ws("_", F.col("rule_id"), F.lit(kind), F.md5(place))


def _requirement_prompt(command: Column) -> Column:
    chain = None
    for words, prompt in REQUIREMENT_PROMPTS:
        hit = has_any(command, words)
        chain = F.when(hit, prompt) if chain is None else chain.when(hit, prompt)
    return chain.otherwise(F.concat(F.lit("What is the recommended way to "), _action(F.col("description")), F.lit("?")))


def _prohibition_prompt(command: Column) -> Column:
    strict = has_any(F.lower("description"), ["never", "don't"])
    generic = F.concat(F.lit("I want to "), _action(F.col("description")), F.lit(". What command should I use?"))
    return (
        F.when(strict & F.contains(command, F.lit("build")), BUILD_PROMPT)
        .when(strict & F.contains(command, F.lit("install")) & F.contains(command, F.lit("npm")), PACKAGE_PROMPT)
        .otherwise(generic)
    )


def _preference_prompt(shown: Column) -> Column:
    low = F.lower("description")
    manager = F.contains(low, F.lit("package manager")) | F.exists("commands", lambda c: has_any(c, ["npm", "yarn", "pnpm"]))
    typed = F.contains(low, F.lit("typescript")) | has_any(F.col("description"), [".tsx", ".ts"])
    return (
        F.when(manager, MANAGER_PROMPT)
        .when(typed, LANGUAGE_PROMPT)
        .when(F.contains(low, F.lit("quote")), QUOTE_PROMPT)
        .otherwise(F.concat(F.lit("What is the recommended approach for: "), shown, F.lit("?")))
    )


def scenarios_from_rules(rules: DataFrame, head: int | None = None) -> DataFrame:
    """One scenario per command of a requirement or prohibition, one per preference that names
    commands, one per workflow rule and one for any other rule. ``head`` limits the
    description in prompts that quote it to its first characters.

    The scenarios of a rule are built inside its row and unfolded, so rules are mined once.
    """
    none = F.array().cast("array<string>")
    kind, expected = F.col("test_type"), F.col("expected_behavior")
    shown = F.col("description") if head is None else F.substring("description", 1, head)
    flow_prompt = F.concat(F.lit("I need to "), _action(F.col("description")), F.lit(". What steps should I follow?"))
    plain_prompt = F.concat(F.lit("What should I know about: "), shown, F.lit("?"))

    def scenario(name: str, label: str, test: str, prompt: Column, behavior: Column, at: Column = F.lit(0)) -> Column:
        return F.struct(
            _scenario_id(name, at).alias("scenario_id"),
            F.lit(label).alias("type"),
            F.lit(test).alias("test_type"),
            prompt.alias("prompt"),
            behavior.alias("expected_behavior"),
        )

    def wants(contain: Column, not_contain: Column) -> Column:
        parts = [contain, not_contain, none, none]
        return F.struct(*[x.alias(k) for x, k in zip(parts, CHECK_KINDS)])

    def required(c: Column, at: Column) -> Column:
        return scenario("cmd_req", "positive", "command_requirement", _requirement_prompt(c), wants(F.array(c), none), at)

    def prohibited(c: Column, at: Column) -> Column:
        return scenario("cmd_prohib", "negative", "command_prohibition", _prohibition_prompt(c), wants(none, F.array(c)), at)

    one = F.array(scenario("pref", "preference", "preference_check", _preference_prompt(shown), expected))
    made = (
        F.when(F.col("type") == "command_requirement", F.transform("commands", required))
        .when(F.col("type") == "command_prohibition", F.transform("commands", prohibited))
        .when((kind == "preference_check") & (F.size("commands") > 0), one)
        .when(kind == "workflow_check", F.array(scenario("workflow", "workflow", "workflow_check", flow_prompt, expected)))
        .when(kind != "preference_check", F.array(scenario("general", "general", "general_check", plain_prompt, expected)))
    )
    return rules.select("rule_id", "doc_id", "section_no", "line_no", "description", F.inline(made))


# ---- response checks


BLOCK_CHARS = 1 << 18  # characters of texts whose windows advance together


def _window_bounds(target: str, text: str) -> np.ndarray:
    """Longest common subsequence of the target with every window of its length.

    A ratio never exceeds this share. Up to 64 characters the subsequence fits the bits of
    one integer, so all windows advance together; longer targets share letters instead.
    """
    size, windows = len(target), len(text) - len(target) + 1
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if size <= 64:
        kind = np.uint32 if size <= 32 else np.uint64
        bits: dict[int, int] = {}
        for i, c in enumerate(target):
            bits[ord(c)] = bits.get(ord(c), 0) | (1 << i)
        letters = np.array(sorted(bits), np.uint32)
        place = np.minimum(np.searchsorted(letters, codes), len(letters) - 1)
        masks = np.where(letters[place] == codes, np.array([bits[c] for c in sorted(bits)], kind)[place], kind(0))
        state = np.full(windows, np.iinfo(kind).max, dtype=kind)
        for step in range(size):
            hit = state & masks[step : step + windows]
            state = (state + hit) | (state - hit)
        return size - np.bitwise_count(state & kind((1 << size) - 1)).astype(np.int64)
    totals = np.zeros(windows, dtype=np.int64)
    for letter, n in Counter(target).items():
        seen = np.concatenate([[0], np.cumsum(codes == ord(letter))])
        totals += np.minimum(seen[size:] - seen[:-size], n)
    return totals


def _matched(where: dict[str, int], window: str, known: int = 0) -> int:
    """Characters in the matching blocks of a target and a window of its length, as SequenceMatcher finds them.

    ``where`` has the places of each letter in the target as bits. A block is the longest
    run, the earliest in the target, then in the window; what lies on either side of it
    follows. Stops once it can't exceed ``known``. Only for fewer than 200 characters: from
    there on SequenceMatcher leaves out frequent ones.
    """
    places = [where.get(c, 0) for c in window]
    total, most, todo = 0, len(window), [(0, len(window), 0, len(window))]
    while todo and most > known:  # what was found and what all open ranges could hold
        a, a_end, b, b_end = todo.pop()
        most -= min(a_end - a, b_end - b)
        if a == a_end or b == b_end:
            continue
        inside = (1 << a_end) - (1 << a)
        single = [x & inside for x in places[b:b_end]]
        runs, size = single, 0
        while any(runs):  # bit i of entry j: a run of size + 1 that ends at i and begins at b + j
            last, size = runs, size + 1
            runs = [x & (y << 1) for x, y in zip(single[size:], last)]
        if not size:
            continue
        first = min([x & -x for x in last if x])
        i = first.bit_length() - size
        j = b + next(k for k, x in enumerate(last) if x & first)
        total += size
        most += min(i - a, j - b) + min(a_end - i, b_end - j)
        todo += [(a, i, b, j), (i + size, a_end, j + size, b_end)]
    return total


def _blocks(texts: Sequence[str]) -> Iterator[list[str]]:
    """Texts in runs of BLOCK_CHARS characters, one text at least."""
    block, chars = [], 0
    for text in texts:
        if block and chars + len(text) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append(text)
        chars += len(text)
    if block:
        yield block


def _best_ratios(target: str, texts: Sequence[str]) -> list[float]:
    """Best similarity of ``target`` with a window of its length, or (short targets) the text, for each text.

    Windows are tried from the highest upper bound down and the search ends when no bound
    can beat the best, which gives the same result as trying every window. The bounds of
    many texts come from one pass; windows that reach into the next text are left out.
    """
    if not target:
        return [1.0] * len(texts)
    size, out = len(target), []
    where: dict[str, int] = {}
    for i, c in enumerate(target):
        where[c] = where.get(c, 0) | (1 << i)
    for block in _blocks(texts):
        joined = "".join(block)
        bounds = _window_bounds(target, joined) if len(joined) >= size else None
        at = 0
        for text in block:
            best, most = 0.0, 0
            if len(text) >= size:
                own = bounds[at : at + len(text) - size + 1]
                for start in np.argsort(-own, kind="stable"):
                    if own[start] / size <= best:
                        break
                    window = text[start : start + size]
                    if size < 200:
                        most = max(most, _matched(where, window, most))
                        best = 2.0 * most / (2 * size)
                    else:
                        best = max(best, SequenceMatcher(None, target, window).ratio())
            if size < 50 and 2 * min(size, len(text)) / (size + len(text)) > best:
                best = max(best, SequenceMatcher(None, target, text).ratio())
            out.append(best)
            at += len(text)
    return out


def _best_ratio(target: str, text: str) -> float:
    """``_best_ratios`` of one text."""
    return _best_ratios(target, [text])[0]


@F.pandas_udf(DoubleType())
def fuzzy_ratio(target: pd.Series, text: pd.Series) -> pd.Series:
    """Best ratio of each row; the rows of a batch that look for the same target go together."""
    out = np.full(len(target), np.nan)
    known = np.flatnonzero((target.notna() & text.notna()).to_numpy())
    wanted, texts = target.to_numpy()[known], text.to_numpy()[known]
    for word, rows in pd.Series(known).groupby(wanted, sort=False).indices.items():
        out[known[rows]] = _best_ratios(word, texts[rows])
    return pd.Series([None if np.isnan(x) else x for x in out], dtype="float64")


def check_contains(response: Column, target: Column, strict: bool = False, case_sensitive: bool = False) -> Column:
    """Confidence of containment, in any case unless ``case_sensitive``: 1 if contained, else the fuzzy ratio.

    Only misses reach Python; hits are passed as null.
    """
    text, word = (response, target) if case_sensitive else (F.lower(response), F.lower(target))
    hit = F.contains(text, word)
    if strict:
        return F.when(hit, 1.0).otherwise(0.0)
    return F.when(hit, 1.0).otherwise(fuzzy_ratio(F.when(~hit, word), F.when(~hit, text)))


def check_command(response: Column, command: Column) -> Column:
    """Confidence that a command is mentioned: 1 in a code span (the command or its first
    word), 0.9 in the text, the share of its words from 70 % on, else 0."""
    parts = F.filter(F.split(F.lower(command), r"\s+"), lambda w: w != "")
    base = F.element_at(F.filter(F.split(command, r"\s+"), lambda w: w != ""), 1)
    in_code = F.exists(commands_in(response), lambda s: F.contains(s, command) | F.contains(s, F.coalesce(base, F.lit(""))))
    text = F.lower(response)
    share = F.coalesce(F.try_divide(F.size(F.filter(parts, lambda w: F.contains(text, w))), F.size(parts)), F.lit(0.0))
    return F.when(in_code, 1.0).when(F.contains(text, F.lower(command)), 0.9).when(share >= 0.7, share).otherwise(0.0)


def result_scenarios(results: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Each result with its scenario. An id names one command of one rule line; rows that repeat
    it (documents with one id) mean the last one. An unknown id leaves ``rule_id`` null,
    which the checks report as a failure."""
    last = scenarios.groupBy("scenario_id").agg(
        F.max_by(F.struct("rule_id", "expected_behavior"), F.struct("doc_id", "section_no", "line_no")).alias("_s")
    )
    return results.join(last, "scenario_id", "left").select(*results.columns, "_s.rule_id", "_s.expected_behavior")


def _check_of(kind: str):
    return lambda target: F.struct(F.lit(kind).alias("kind"), target.alias("target"))


def check_not_contains(response: Column, target: Column, case_sensitive: bool = False) -> Column:
    """Whether the response is free of the target."""
    return ~F.contains(response, target) if case_sensitive else ~F.contains(F.lower(response), F.lower(target))


def check_not_command(response: Column, command: Column) -> Column:
    """Whether the response does not mention the command at all."""
    return check_command(response, command) == 0


def response_checks(paired: DataFrame, case_sensitive: bool = False, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row per result and expectation with found, passed and confidence; a result that
    expects nothing keeps one row without a check. Failed runs (a null ``success`` is a
    failed one) and unknown scenarios are not checked."""
    checked = F.col("success") & F.col("rule_id").isNotNull()
    wanted = F.concat(
        *[
            F.transform(
                F.coalesce(F.col(f"expected_behavior.{k}"), F.array().cast("array<string>")),
                _check_of(k),
            )
            for k in CHECK_KINDS
        ]
    )
    wanted = F.explode_outer(F.when(checked, wanted)).alias("c")
    rows = paired.select("result_id", "scenario_id", "rule_id", "success", "response", wanted)
    kind, target = F.col("c.kind"), F.col("c.target")
    text = F.col("response")
    contain = check_contains(F.when(kind == "should_contain", text), F.when(kind == "should_contain", target), case_sensitive=case_sensitive)
    command = check_command(text, target)
    passed = (
        F.when(kind == "should_contain", contain >= min_confidence)
        .when(kind == "should_not_contain", check_not_contains(text, target, case_sensitive))
        .when(kind == "should_execute", command > 0)
        .when(kind == "should_not_execute", check_not_command(text, target))
    )
    sure = F.when(kind == "should_contain", contain).when(kind == "should_execute", command)
    return rows.select(
        "result_id",
        "scenario_id",
        "rule_id",
        "success",
        kind.alias("kind"),
        target.alias("target"),
        passed.alias("passed"),
        F.coalesce(sure, F.when(passed, 1.0).otherwise(0.0)).alias("confidence"),
    )


def result_checks(checks: DataFrame) -> DataFrame:
    """Fold the checks of each result: no check passes with confidence 1, a failed run or an
    unknown scenario fails."""
    real = F.col("kind").isNotNull()
    folded = checks.groupBy("result_id", "scenario_id", "rule_id", "success").agg(
        F.count_if(real).alias("total"),
        F.count_if(real & F.col("passed")).alias("checks_passed"),
        F.coalesce(F.avg(F.when(real, F.col("confidence"))), F.lit(1.0)).alias("confidence"),
    )
    known = F.col("rule_id").isNotNull()
    ran = F.coalesce("success", F.lit(False))
    reason = F.when(~known, "Scenario not found").when(~ran, "Test execution failed")  # fixed values
    passed = known & ran & (F.col("checks_passed") == F.col("total"))
    return folded.select(
        "result_id",
        "scenario_id",
        F.coalesce("rule_id", F.lit("unknown")).alias("rule_id"),
        passed.alias("passed"),
        "confidence",
        "checks_passed",
        (F.col("total") - F.col("checks_passed")).alias("checks_failed"),
        "total",
        reason.alias("reason"),
    )


def consistency(validations: DataFrame) -> DataFrame:
    rate = F.count_if("passed") / F.count("*")
    return validations.groupBy("scenario_id").agg(
        F.count("*").alias("iterations"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        rate.alias("rate"),
        (rate >= CONSISTENT_SHARE).alias("is_consistent"),
    )


def rule_pass_rates(validations: DataFrame) -> DataFrame:
    rate = F.count_if("passed") / F.count("*") * 100
    return validations.groupBy("rule_id").agg(
        F.count("*").alias("tests"), F.count_if("passed").alias("passed"), rate.alias("pass_rate"), (rate >= 80).alias("ok")
    )


def validation_summary(validations: DataFrame) -> DataFrame:
    """One row: scenarios and rules fold first, so the last step sees one row of each."""
    per = validations.groupBy("scenario_id", "rule_id").agg(F.count("*").alias("n"), F.count_if("passed").alias("p"))
    scenarios = per.groupBy("scenario_id").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    steady = F.col("p") / F.col("n") >= CONSISTENT_SHARE
    parts = scenarios.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_tests"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("passed"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.coalesce(F.sum("p"), F.lit(0))).alias("failed"),
        F.coalesce(F.try_divide(F.sum("p"), F.sum("n")), F.lit(0.0)).alias("pass_rate"),
        F.count("*").alias("total_scenarios"),
        F.count_if(steady).alias("consistent_scenarios"),
        F.count_if(~steady).alias("inconsistent_scenarios"),
    ).unionByName(per.agg(F.count_distinct("rule_id").alias("total_rules")), True)
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


def report_rows(validations: DataFrame) -> DataFrame:
    """The report as JSON lines: a summary line, one per scenario, one per rule and one per validation.

    Scenario and rule lines hold the counts of their validations, whose own lines name both,
    so no group has to be one value.
    """
    def lines(kind: str, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*columns)).alias("line"))

    summary, scenarios, rules = validation_summary(validations), consistency(validations), rule_pass_rates(validations)
    fields = ["result_id", "scenario_id", "rule_id", "iteration", "passed", "confidence", "checks_passed", "checks_failed", "duration_ms", "reason"]
    out = lines("summary", summary, summary.columns).unionByName(lines("scenario", scenarios, scenarios.columns))
    return out.unionByName(lines("rule", rules, rules.columns)).unionByName(lines("validation", validations, fields))


def report_markdown(validations: DataFrame) -> DataFrame:
    """Markdown lines with their order: heading, totals, and a table row per rule."""
    s = validation_summary(validations)
    share = F.format_string("%.1f", F.col("pass_rate") * 100)
    top = [
        F.lit("# Rule report"),
        F.concat(F.lit("Tests: "), "total_tests", F.lit(", passed: "), "passed", F.lit(", failed: "), "failed"),
        F.concat(F.lit("Pass rate: "), share, F.lit(" %")),
        F.lit("| Rule | Pass rate | |"),
        F.lit("| --- | --- | --- |"),
    ]
    head = s.select(F.posexplode(F.array(*top)).alias("part", "line")).withColumn("rule_id", F.lit(""))
    rates = rule_pass_rates(validations)
    row = F.concat(
        F.lit("| "), "rule_id", F.lit(" | "), F.format_string("%.1f", "pass_rate"), F.lit(" % | "), F.when(F.col("ok"), "✓").otherwise("✗"), F.lit(" |")
    )
    body = rates.select(F.lit(len(top)).alias("part"), row.alias("line"), "rule_id")
    return head.unionByName(body)
