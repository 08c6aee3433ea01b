"""Many words or patterns looked for in many texts, through postings of their rarest n-grams.

A text that contains a literal contains all its n-grams. Each literal is looked up by
one of them, the one that fewest texts have; the texts' n-grams meet the literals' in an
equi-join, and only the pairs found are tested in full. The plan does not grow with the
number of literals, and texts and literals never meet as a product.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgauge.functions.patterns import valid_regexes

GRAM = 4  # code units of an n-gram; shorter literals use their own length


def grams(text: Column, size: int) -> Column:
    """Distinct n-grams of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _exploded(texts: DataFrame, key: str, sizes: Iterable[int]) -> DataFrame:
    """(key, gram) for the n-grams of the given sizes."""
    lists = [grams(F.col("text"), n) for n in sorted(sizes)]
    return texts.select(F.col(key), F.explode(F.flatten(F.array(*lists)) if len(lists) > 1 else lists[0]).alias("gram"))


def contained(texts: DataFrame, literals: DataFrame) -> DataFrame:
    """(key, literal): which of the ``literals`` each text contains, both taken as they are.

    ``texts`` is (key, text) with unique keys of any type, ``literals`` (literal) without
    repeats. Empty literals and nulls are in no row. One pass over the texts counts the
    n-grams that some literal has, a second one looks the literals up.
    """
    literals = literals.select("literal").filter(F.length("literal") > 0)
    size = F.least(F.length("literal"), F.lit(GRAM))
    sizes = [r[0] for r in literals.select(size.alias("n")).distinct().collect()]  # GRAM numbers at most
    if not sizes:
        return texts.select("key").withColumn("literal", F.lit("")).limit(0)
    own = F.lit(None).cast("array<string>")
    for n in sizes:
        own = F.when(size == n, grams(F.col("literal"), n)).otherwise(own)
    listed = literals.select("literal", F.explode(own).alias("gram"))
    wanted = listed.select(F.col("gram").alias("known")).distinct()
    counts = _exploded(texts, "key", sizes).join(wanted, F.col("gram") == F.col("known"), "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    # a literal with an n-gram that no text has is in no text
    rarity = listed.join(counts.withColumnRenamed("gram", "known"), F.col("gram") == F.col("known"), "left")
    first = Window.partitionBy("literal").orderBy(F.col("n").asc_nulls_first(), "gram")
    chosen = rarity.withColumn("place", F.row_number().over(first)).filter("place = 1 and n is not null").select("literal", F.col("gram").alias("known"))
    met = _exploded(texts, "key", sizes).join(chosen, F.col("gram") == F.col("known")).select(F.col("key").alias("of"), "literal")
    # an n-gram of a text is listed once, and a literal has one: no pair comes twice
    return texts.join(met, F.col("key") == F.col("of")).filter(F.contains("text", F.col("literal"))).select("key", "literal")


# ---- the literal that a regular expression needs

_NO_LITERAL_AFTER = set("dDwWsSbBAZzGhHvVRXnrtfae")  # escapes that stand for no fixed letter here


def required_literal(pattern: str) -> str:
    """The longest run of letters that every match must hold; empty where none is certain.

    Reads only the outermost sequence: groups, classes and repeated letters end a run.
    Alternatives at that level, flags, quoting and the rarer escapes give nothing.
    """
    best, run, i = "", "", 0
    if any(x in pattern for x in ("(?", r"\Q", r"\c", r"\0", r"\N")):
        return ""

    def ended(by: str = "") -> None:
        nonlocal best, run
        best, run = max(best, run, key=len), by

    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "|":
            return ""
        if c in "^$.":
            ended()
        elif c in "*?{":  # what came before may be missing
            run = run[:-1]
            ended()
            if c == "{":
                i = pattern.find("}", i) + 1 or len(pattern)
        elif c == "+":
            ended()
        elif c in "([":
            ended()
            i = _closed(pattern, i - 1)
        elif c == "\\":
            if i == len(pattern):
                return ""
            e = pattern[i]
            i += 1
            if e.isdigit() or e in _NO_LITERAL_AFTER:
                ended()
            elif e.isalpha():  # \\p, \\x, \\u, \\k and others take arguments
                return ""
            else:
                run += e
        else:
            run += c
    ended()
    return best


def _closed(pattern: str, start: int) -> int:
    """Index after the bracket that closes the one at ``start``."""
    depth, i, in_class = 0, start, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            in_class += 1
        elif c == "]" and in_class and pattern[i - 1] != "[" and pattern[i - 2 : i] != "[^":
            in_class -= 1
            if not in_class and not depth:
                return i + 1
        elif not in_class and c == "(":
            depth += 1
        elif not in_class and c == ")":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return len(pattern)


def matched_texts(texts: DataFrame, patterns: Sequence[str], kind: str = "contains") -> DataFrame:
    """(text): the distinct ``texts`` (text) that some pattern covers, as ``functions.patterns.matches`` has it."""
    spark = texts.sparkSession
    texts = texts.select("text").filter("text is not null").distinct()

    def frame(values: Iterable, columns: str) -> DataFrame:
        return spark.createDataFrame(sorted(set(values)), columns)

    if kind == "exact":
        return texts.join(frame([(p,) for p in patterns], "wanted string"), F.col("text") == F.col("wanted"), "left_semi")
    if kind not in ("contains", "regex"):
        raise ValueError(f"unknown match kind {kind!r}")
    good = valid_regexes(spark, patterns) if kind == "regex" else set()
    plain = {p.lower() for p in patterns if p not in good}
    parts = []
    if "" in plain:
        return texts
    if plain:
        lowered = texts.select(F.lower("text").alias("text")).distinct().select(F.col("text").alias("key"), "text")
        found = contained(lowered, frame([(p,) for p in plain], "literal string")).select("key").distinct()
        parts.append(texts.join(found, F.lower("text") == F.col("key"), "left_semi"))
    needs = {p: required_literal(p) for p in good}
    if any(needs.values()):
        pairs = frame([(n, p) for p, n in needs.items() if n], "needed string, pattern string")
        found = contained(texts.select(F.col("text").alias("key"), "text"), pairs.select(F.col("needed").alias("literal")).distinct())
        tried = found.join(pairs, F.col("literal") == F.col("needed")).filter(F.rlike("key", F.col("pattern")))
        parts.append(tried.select(F.col("key").alias("text")).distinct())
    bare = sorted(p for p, n in needs.items() if not n)
    if bare:  # nothing to look up: these are tried on every text
        joined = [p for p in bare if "\\" not in p and "(?" not in p]
        hit = F.exists(F.array(*[F.lit(p) for p in bare if p not in joined]), lambda p: F.rlike("text", p)) if len(joined) < len(bare) else F.lit(False)
        if joined:
            hit = hit | F.rlike("text", F.lit("|".join(f"(?:{p})" for p in joined)))
        parts.append(texts.filter(hit))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.distinct() if len(parts) > 1 else out


def with_matched(rows: DataFrame, column: str, patterns: Sequence[str], kind: str = "contains") -> DataFrame:
    """``rows`` with a boolean ``matched``: whether some pattern covers the text; a null text is never covered.

    Repeated texts, of which logs are full, are tested once.
    """
    if not patterns:
        return rows.withColumn("matched", F.lit(False))
    found = matched_texts(rows.select(F.col(column).alias("text")), patterns, kind).select(F.col("text").alias("_covered"))
    joined = rows.join(found, F.col(column) == F.col("_covered"), "left")
    return joined.withColumn("matched", F.col("_covered").isNotNull()).drop("_covered")
