"""Text matching by exact value, substring or regular expression."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


_KNOWN: dict[str, bool] = {}


def compiles(pattern: Column) -> Column:
    """Whether the engine's own expressions library takes ``pattern``."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("matches"), pattern, F.lit("")).isNotNull()


def valid_regexes(spark: SparkSession, patterns: Iterable[str]) -> set[str]:
    """Those that the engine which will run them compiles; one query over the patterns not seen before."""
    wanted = set(patterns)
    new = sorted(wanted - _KNOWN.keys())
    if new:
        _KNOWN.update(spark.createDataFrame([(p,) for p in new], "p string").select("p", compiles(F.col("p"))).collect())
    return {p for p in wanted if _KNOWN[p]}


def is_valid_regex(pattern: str) -> bool:
    """Whether the active session's engine compiles ``pattern``; needs a session where it was not asked before."""
    if pattern in _KNOWN:
        return _KNOWN[pattern]
    session = SparkSession.getActiveSession()
    if session is None:
        raise RuntimeError("a Spark session is needed to compile a pattern")
    return bool(valid_regexes(session, [pattern]))


def matches(text: Column, pattern: str, kind: str = "contains") -> Column:
    """exact and regex mind the case, contains does not; a broken regex acts as contains."""
    if kind == "exact":
        return text == pattern
    if kind == "regex" and is_valid_regex(pattern):
        return text.rlike(pattern)
    if kind in ("contains", "regex"):
        return F.contains(F.lower(text), F.lit(pattern.lower()))
    raise ValueError(f"unknown match kind {kind!r}")


def matches_cased(text: Column, pattern: str, kind: str = "contains") -> Column:
    """The assertions' variant: contains minds the case, a broken regex never matches."""
    if kind == "exact":
        return text == pattern
    if kind == "contains":
        return F.contains(text, F.lit(pattern))
    if kind == "regex":
        return text.rlike(pattern) if is_valid_regex(pattern) else F.lit(False)
    raise ValueError(f"unknown match kind {kind!r}")


def matches_any(text: Column, patterns: Sequence[str], kind: str = "contains") -> Column:
    if kind == "regex" and SparkSession.getActiveSession() is not None:
        valid_regexes(SparkSession.getActiveSession(), patterns)  # all at once
    return reduce(lambda a, b: a | b, [matches(text, p, kind) for p in patterns], F.lit(False))
