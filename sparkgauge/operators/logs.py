"""Console entries: filters, captures, error categories, summaries and checks.

Entries are (collection_id, seq, ts_ms, level, message, url).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgauge.functions.patterns import matches, matches_any, matches_cased
from sparkgauge.operators.postings import with_matched

FEW_PATTERNS = 16  # so many conditions cost a scan less than a join

# Log levels, and the error categories in order of precedence.
LEVELS = ["log", "info", "warn", "error", "debug"]
ERROR_CATEGORIES = {
    "cors": ["cors", "cross-origin", "access-control", "blocked by cors"],
    "network": ["network", "fetch", "xhr", "ajax", "request failed", "timeout", "connection"],
    "script": [
        "syntax error",
        "reference error",
        "type error",
        "uncaught",
        "undefined",
        "is not a function",
        "cannot read property",
    ],
    "resource": ["failed to load", "404", "not found", "resource", r"\.js", r"\.css", r"\.png", r"\.jpg", r"\.svg"],
}


def _level(name: str) -> Column:
    return F.col("level") == name


# ---- filters


def filter_pattern(entries: DataFrame, pattern: str, kind: str = "contains") -> DataFrame:
    """All entries with ``matched``."""
    return entries.withColumn("matched", F.coalesce(matches(F.col("message"), pattern, kind), F.lit(False)))


def filter_patterns(entries: DataFrame, patterns: Sequence[str], kind: str = "contains") -> DataFrame:
    """All entries with ``matched``: a few patterns are one condition of the scan, many are
    looked up by n-grams, with the same result."""
    if len(patterns) > FEW_PATTERNS:
        return with_matched(entries, "message", patterns, kind)
    return entries.withColumn("matched", F.coalesce(matches_any(F.col("message"), patterns, kind), F.lit(False)))


def filter_level(entries: DataFrame, levels: str | Sequence[str]) -> DataFrame:
    return entries.filter(F.col("level").isin([levels] if isinstance(levels, str) else list(levels)))


def filter_allowed(entries: DataFrame, patterns: Sequence[str], kind: str = "contains") -> DataFrame:
    """Entries no allowed pattern covers; an empty list keeps all."""
    return filter_patterns(entries, patterns, kind).filter(~F.col("matched")).drop("matched")


def filter_forbidden(entries: DataFrame, patterns: Sequence[str], kind: str = "contains") -> DataFrame:
    """Entries some forbidden pattern covers; an empty list keeps none."""
    return filter_patterns(entries, patterns, kind).filter("matched").drop("matched")


def _narrow(
    entries: DataFrame, levels: Sequence[str] | None, start_ms: int | None, end_ms: int | None, limit: int | None
) -> DataFrame:
    if levels:
        entries = filter_level(entries, levels)
    if start_ms is not None:
        entries = entries.filter(F.col("ts_ms") >= start_ms)
    if end_ms is not None:
        entries = entries.filter(F.col("ts_ms") <= end_ms)
    return entries.orderBy("seq").limit(limit) if limit else entries


def filter_entries(
    entries: DataFrame,
    levels: Sequence[str] | None = None,
    start_ms: int | None = None,
    end_ms: int | None = None,
    text: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Level, closed time range, substring in any case, first ``limit`` by sequence."""
    if text:
        entries = entries.filter(matches(F.col("message"), text))
    return _narrow(entries, levels, start_ms, end_ms, limit)


def filter_console_regex(
    entries: DataFrame,
    levels: Sequence[str] | None = None,
    start_ms: int | None = None,
    end_ms: int | None = None,
    pattern: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """As ``filter_entries`` with a regular expression in any case."""
    if pattern:
        entries = entries.filter(F.col("message").rlike(f"(?i){pattern}"))
    return _narrow(entries, levels, start_ms, end_ms, limit)


def normalize_console(raw: DataFrame) -> DataFrame:
    """Defaults of a raw entry: level log, text or message, source only with url or source."""
    has_source = F.col("source").isNotNull() | F.col("url").isNotNull()
    return raw.select(
        "id",
        F.coalesce("level", F.lit("log")).alias("level"),
        F.coalesce("text", "message").alias("text"),
        F.date_format(F.timestamp_millis("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.when(has_source, F.struct("url", "line")).alias("source"),
    )


# ---- captures


def console_collection(entries: DataFrame) -> DataFrame:
    """One row per capture: first and last entry by sequence, counts per level."""
    counts = [F.count_if(_level(x)).alias(f"{x}_count") for x in LEVELS]
    return entries.groupBy("collection_id").agg(
        F.min("url").alias("url"),
        F.min_by("ts_ms", "seq").alias("start_ms"),
        F.max_by("ts_ms", "seq").alias("end_ms"),
        F.count("*").alias("total"),
        *counts,
    )


def query_collections(
    captures: DataFrame,
    url: str | None = None,
    start_ms: int | None = None,
    end_ms: int | None = None,
    has_errors: bool = False,
    has_warnings: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Captures by url, overlap with a time range, errors, warnings; newest first.

    The reference cuts to the limit before it sorts; here the newest are kept.
    """
    if url:
        captures = captures.filter(F.col("url") == url)
    if start_ms is not None:
        captures = captures.filter(F.col("end_ms") >= start_ms)
    if end_ms is not None:
        captures = captures.filter(F.col("start_ms") <= end_ms)
    if has_errors:
        captures = captures.filter("error_count > 0")
    if has_warnings:
        captures = captures.filter("warn_count > 0")
    ordered = captures.orderBy(F.col("start_ms").desc(), F.col("collection_id").desc())
    return ordered.limit(limit) if limit else ordered


def query_by_level(captures: DataFrame, level: str) -> DataFrame:
    return captures.filter(F.col(f"{level}_count") > 0).orderBy(F.col("start_ms").desc(), "collection_id")


def search_console(entries: DataFrame, text: str) -> DataFrame:
    """Entries holding the text, one row each with their capture; captures without a hit
    have no row. Hits stay rows, so a busy capture is not folded into one array."""
    return entries.filter(matches(F.col("message"), text)).select(
        "collection_id", "seq", "ts_ms", "level", "message"
    )


def search_console_counts(entries: DataFrame, text: str) -> DataFrame:
    return search_console(entries, text).groupBy("collection_id").agg(F.count("*").alias("matches"))


# ---- summaries


def error_category(message: Column) -> Column:
    """First category with a matching pattern, any case; else ``other``."""
    result = None
    for name, patterns in ERROR_CATEGORIES.items():
        hit = message.rlike("(?i)" + "|".join(patterns))
        result = F.when(hit, name) if result is None else result.when(hit, name)
    return result.otherwise("other")


def error_categories(entries: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Error count per category."""
    errors = filter_level(entries, "error")
    return errors.groupBy(*keys, error_category(F.col("message")).alias("category")).agg(F.count("*").alias("n"))


def console_summary(entries: DataFrame, keys: Sequence[str] = ("collection_id",), categories: bool = False) -> DataFrame:
    """Counts per level and distinct error and warning messages, per capture.

    Entries fold to one row per level and message first. That makes the distinct counts
    plain counts, and each distinct message is categorized once. The messages themselves
    are rows of ``unique_messages``.
    """
    folded = entries.groupBy(*keys, "level", "message").agg(F.count("*").alias("_n"))

    def total(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("_n"))), F.lit(0))

    def distinct(level: str) -> Column:
        return F.count_if(_level(level) & F.col("message").isNotNull())

    aggs = [F.sum("_n").alias("total")]
    aggs += [total(_level(x)).alias(f"{x}_count") for x in LEVELS]
    aggs += [distinct("error").alias("unique_errors"), distinct("warn").alias("unique_warnings")]
    if categories:
        kind = F.when(_level("error"), error_category(F.col("message")))
        folded = folded.withColumn("_kind", kind)
        aggs += [total(F.col("_kind") == c).alias(f"{c}_errors") for c in [*ERROR_CATEGORIES, "other"]]
    return folded.groupBy(*keys).agg(*aggs)


def unique_messages(entries: DataFrame, keys: Sequence[str] = ("collection_id",)) -> DataFrame:
    kept = filter_level(entries, ["error", "warn"])
    return kept.groupBy(*keys, "level", "message").agg(F.count("*").alias("n"))


def console_global_stats(captures: DataFrame) -> DataFrame:
    totals = [F.coalesce(F.sum(f"{x}_count"), F.lit(0)).alias(f"{x}_count") for x in LEVELS]
    return captures.agg(
        F.count("*").alias("captures"), F.coalesce(F.sum("total"), F.lit(0)).alias("entries"), *totals
    )


def error_index(entries: DataFrame) -> DataFrame:
    """Every error with its capture's url. One row per error; ``error_index_heads`` has the counts."""
    return filter_level(entries, "error").select("collection_id", "url", "seq", "ts_ms", "message")


def error_index_heads(entries: DataFrame) -> DataFrame:
    return (
        entries.groupBy("collection_id")
        .agg(
            F.min("url").alias("url"),
            F.min_by("ts_ms", "seq").alias("start_ms"),
            F.count_if(_level("error")).alias("error_count"),
        )
        .filter("error_count > 0")
    )


# ---- checks: rules compile to conditional aggregates, so one pass checks all rules


def _rule_rows(df: DataFrame, keys: Sequence[str], results: list[Column]) -> DataFrame:
    return df.select(*keys, F.inline(F.array(*results)))


def _result(rule: str, passed: Column, expected: str, actual: Column, error: Column) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"),
        passed.alias("passed"),
        F.lit(expected).alias("expected"),
        actual.cast("string").alias("actual"),
        F.when(~passed, error).alias("error"),
    )


def assert_limits(entries: DataFrame, max_errors: int | None = None, max_warnings: int | None = None) -> DataFrame:
    """Per capture: errors and warnings within their limits."""
    counted = entries.groupBy("collection_id").agg(
        F.count_if(_level("error")).alias("errors"), F.count_if(_level("warn")).alias("warnings")
    )
    results = []
    for noun, limit in (("errors", max_errors), ("warnings", max_warnings)):
        if limit is not None:
            actual = F.concat_ws(" ", F.col(noun), F.lit(noun))
            error = F.concat(F.lit("Found "), F.col(noun), F.lit(f" {noun}, but maximum allowed is {limit}"))
            results.append(_result(f"max_{noun}", F.col(noun) <= limit, f"<= {limit} {noun}", actual, error))
    return _rule_rows(counted, ["collection_id"], results)


def assert_messages(entries: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """Expected and forbidden messages per capture.

    A rule is ``{"want": "expected"|"forbidden", "text", "level"?, "match"?}``; contains
    minds the case. The reported message is the first hit by sequence.
    """
    firsts = []
    for i, rule in enumerate(rules):
        hit = matches_cased(F.col("message"), rule["text"], rule.get("match", "contains"))
        if rule.get("level"):
            hit = hit & _level(rule["level"])
        firsts.append(F.min(F.when(hit, F.struct("seq", "message"))).alias(f"h{i}"))
    hits = entries.groupBy("collection_id").agg(*firsts)
    results = []
    for i, rule in enumerate(rules):
        found, message = F.col(f"h{i}").isNotNull(), F.col(f"h{i}.message")
        level = f"{rule['level']} " if rule.get("level") else ""
        name = f"{rule['want']}:{level}{rule['text']}"
        if rule["want"] == "expected":
            none = F.lit(f"No matching {level}message found")
            error = F.lit(f'Expected {level}message not found: "{rule["text"]}"')
            results.append(_result(name, found, rule["text"], F.coalesce(message, none), error))
        else:
            error = F.concat(F.lit(f'Forbidden {level}message found: "'), message, F.lit('"'))
            actual = F.coalesce(message, F.lit("No matching message found"))
            results.append(_result(name, ~found, "Message not found", actual, error))
    return _rule_rows(hits, ["collection_id"], results)


def missing_capture(rules: DataFrame, captures: DataFrame, key: str = "collection_id") -> DataFrame:
    """One failed row per rule whose capture does not exist."""
    lost = rules.join(captures.select(key).distinct(), key, "left_anti")
    return lost.select("*", F.lit(False).alias("passed"), F.lit("Capture not found").alias("error"))


def assertion_rollup(assertions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All passed, failed and total, with the result line, per group."""
    counted = assertions.groupBy(*keys).agg(
        F.every("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count("*").alias("total")
    )
    bad = F.concat(F.lit("failed: "), "failed", F.lit(" of "), "total", F.lit(" assertions failed"))
    good = F.concat(F.lit("passed: all "), "total", F.lit(" assertions passed"))
    return counted.withColumn("message", F.when(F.col("passed"), good).otherwise(bad))


def checkpoint_verdict(validations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All validations passed, and a line that names the types of the failed ones.

    Failures are counted per type first, so the shuffle carries types, not validations;
    the line lists types in name order, those that failed more than once with their count.
    """
    per_type = validations.groupBy(*keys, "type").agg(
        F.count("*").alias("_n"), F.count_if(~F.col("passed")).alias("_bad")
    )
    bad, once = F.col("_bad"), F.struct("type", "_bad")
    named = F.transform(
        F.array_sort(F.collect_list(F.when(bad > 0, once))),
        lambda x: F.when(x["_bad"] == 1, x["type"]).otherwise(F.concat(x["type"], F.lit(" x"), x["_bad"])),
    )
    folded = per_type.groupBy(*keys).agg(
        F.sum("_n").alias("total"), F.sum("_bad").alias("failed"), F.array_join(named, ", ").alias("_types")
    )
    good = F.concat(F.lit("All "), "total", F.lit(" validation(s) passed"))
    bad = F.concat("failed", F.lit(" of "), "total", F.lit(" validation(s) failed ("), "_types", F.lit(")"))
    return folded.select(
        *keys,
        (F.col("failed") == 0).alias("passed"),
        "failed",
        "total",
        F.when(F.col("failed") == 0, good).otherwise(bad).alias("message"),
    )

