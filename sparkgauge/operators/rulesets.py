"""Checks whose rules are rows: any number of rules, for all pages or captures or for one.

Rules meet nodes and messages by equi-joins, never as a product, and the plan does not grow
with them. A page rule is looked up under its page and one key of its selector (id, class,
attribute or tag, in that order) in an index of the nodes; a message rule under its capture
and the rarest n-gram of what it looks for. The rest of a rule is tested on the pairs found.
A rule for all pages or captures has a row for each of them, as its results do, so a rule of
one page never meets the nodes of another.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sparkgauge.functions.patterns import compiles
from sparkgauge.functions.textfns import strip_space
from sparkgauge.operators.postings import contained, required_literal

PAGE_RULES = (
    "rule long, page_id long, kind string, selector string, operator string, count long,"
    "attribute string, value string, text string, match string"
)
LOG_RULES = "rule long, collection_id long, kind string, count long, text string, level string, match string"
FEW_KEYS = 64  # so many different selector keys are looked for in each element before the index is shuffled
# Fixed value: the sign of each comparison.
SIGNS = {"equal": "=", "greaterThan": ">", "lessThan": "<", "greaterThanOrEqual": ">=", "lessThanOrEqual": "<="}


def rule_rows(spark: SparkSession, rules: Iterable[Mapping], shape: str) -> DataFrame:
    """Rules given as mappings, numbered from 0 where they have no number; null stands for what they leave out."""
    names = [field.split()[0] for field in shape.split(",")]
    return spark.createDataFrame([tuple({"rule": i, **r}.get(n) for n in names) for i, r in enumerate(rules)], shape)


def _to_each(subjects: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """``subjects`` (key) with the columns of every one of ``rules``, which are for all of them."""
    listed = rules.agg(F.collect_list(F.struct(*rules.columns))).scalar()
    return subjects.select(key).withColumn("_rules", listed).select(key, F.inline("_rules"))


def _for_all(subjects: DataFrame, key: str, rules: DataFrame, shown: DataFrame) -> DataFrame:
    """(key, columns of ``shown``): every rule without a key for every subject, and the others for theirs.

    ``shown`` (rule, ...) meets the rules for all before these meet the subjects: no number is a hot key.
    """
    numbers = rules.filter(F.col(key).isNull()).select("rule")
    every = _to_each(subjects, key, numbers.join(shown, "rule"))
    own = rules.filter(F.col(key).isNotNull()).select(key, "rule").join(subjects.select(key), key, "left_semi")
    return every.unionByName(own.join(shown, "rule"))


def _sought(subjects: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """``rules`` with a key each: those without one come once for every distinct subject."""
    common = rules.filter(F.col(key).isNull() & F.col("rule").isNotNull()).drop(key)
    return _to_each(subjects.select(key).distinct(), key, common).unionByName(rules.filter(F.col(key).isNotNull()))


def _lost(subjects: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """Rules for a page or capture that is not there."""
    return rules.filter(F.col(key).isNotNull()).join(subjects.select(key), key, "left_anti")


def _cased(actual: Column, wanted: Column, match: Column, valid: Column) -> Column:
    """Contains minds the case, and a broken expression never matches."""
    safe = F.when(valid, wanted).otherwise("")
    found = F.when(match == "exact", actual == wanted).when(match == "contains", F.contains(actual, wanted))
    return F.coalesce(found.when((match == "regex") & valid, F.rlike(actual, safe)), F.lit(False))


def _chosen(kind: Column, cases: dict[str, Column], other: Column) -> Column:
    out = F.when(F.lit(False), other)
    for name, value in cases.items():
        out = out.when(kind == name, value)
    return out.otherwise(other)


# ---- pages

_PART = r"""[#.][\w-]+|\[[\w-]+(?:=(?:"[^"]*"|'[^']*'|[^\]]*))?\]"""
_LEAD = r"[a-zA-Z][\w-]*|\*"


def parsed(rules: DataFrame) -> DataFrame:
    """``rules`` with the parts of their selectors and ``sel_key``, the key they are looked up by; null where unsupported."""
    text = F.trim("selector")
    lead = F.regexp_extract(text, f"^({_LEAD})", 1)
    parts = F.regexp_extract_all(F.substr(text, F.length(lead) + 1), F.lit(f"({_PART})"), F.lit(1))
    of = lambda sign: F.transform(F.filter(parts, lambda p: p.startswith(sign)), lambda p: F.substr(p, F.lit(2)))
    inner = F.transform(of("["), lambda p: F.substr(p, F.lit(1), F.length(p) - 1))

    def attribute(p: Column) -> Column:
        name = F.substring_index(p, "=", 1)
        value = F.regexp_replace(F.substr(p, F.length(name) + 2), "^[\"']+|[\"']+$", "")
        return F.struct(name.alias("name"), F.when(F.contains(p, F.lit("=")), value).alias("value"))

    tag = F.when(lead != "*", F.lower(lead)).otherwise("")
    rules = rules.select(
        "*", tag.alias("sel_tag"), of("#").alias("sel_ids"), of(".").alias("sel_classes"), F.transform(inner, attribute).alias("sel_attributes")
    )
    key = (
        F.when(F.size("sel_ids") > 0, F.concat(F.lit("#"), F.get("sel_ids", F.lit(0))))
        .when(F.size("sel_classes") > 0, F.concat(F.lit("."), F.get("sel_classes", F.lit(0))))
        .when(F.size("sel_attributes") > 0, F.concat(F.lit("["), F.get("sel_attributes", F.lit(0))["name"]))
        .when(F.col("sel_tag") != "", F.concat(F.lit(" "), "sel_tag"))
        .otherwise("*")
    )
    fine = (text != "") & text.rlike(f"^(?:{_LEAD})?(?:{_PART})*$")
    return rules.withColumn("sel_key", F.when(fine, key))


def node_index(nodes: DataFrame, wanted: Column | None = None) -> DataFrame:
    """A row per element and key: its tag, id, classes, attribute names and ``*``; of these only the ``wanted`` (an array) if given."""
    attributes = F.col("attributes")
    keys = F.concat(
        F.array(F.lit("*"), F.concat(F.lit(" "), "tag"), F.concat(F.lit("#"), attributes["id"])),
        F.coalesce(F.transform(F.split(attributes["class"], r"\s+"), lambda c: F.concat(F.lit("."), c)), F.array().cast("array<string>")),
        F.coalesce(F.transform(F.map_keys(attributes), lambda k: F.concat(F.lit("["), k)), F.array().cast("array<string>")),
    )
    keys = F.array_distinct(F.array_compact(keys))
    elements = nodes.filter(F.col("tag") != "#text").select("page_id", "node_idx", "last_idx", "tag", "attributes", keys.alias("keys"))
    if wanted is not None:
        elements = elements.withColumn("wanted", wanted)
        elements = elements.withColumn("keys", F.when(F.col("wanted").isNull(), F.col("keys")).otherwise(F.array_intersect("keys", "wanted")))
    return elements.select("page_id", "node_idx", "last_idx", "tag", "attributes", F.explode("keys").alias("key"))


def _hits(pages: DataFrame, nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, rule, n, first, is_text): how often a rule's selector matches on a page, its first match, whether it is a text rule."""
    readable = rules.filter(F.col("sel_key").isNotNull()).select(
        "rule", "page_id", "kind", "attribute", F.col("sel_key").alias("key"), "sel_tag", "sel_ids", "sel_classes", "sel_attributes"
    )
    # few different keys: only these are indexed
    few = readable.select("key").distinct().limit(FEW_KEYS + 1).agg(F.collect_list("key").alias("keys"))
    few = few.select(F.when(F.size("keys") <= FEW_KEYS, F.col("keys"))).scalar()
    met = node_index(nodes, few).join(_sought(pages, "page_id", readable), ["page_id", "key"])
    attributes = F.col("attributes")
    fits = (
        ((F.col("sel_tag") == "") | (F.col("sel_tag") == F.col("tag")))
        & F.forall("sel_ids", lambda x: F.coalesce(attributes["id"] == x, F.lit(False)))
        & F.forall("sel_classes", lambda x: F.coalesce(F.array_contains(F.split(attributes["class"], r"\s+"), x), F.lit(False)))
        & F.forall(
            "sel_attributes",
            lambda x: F.when(x["value"].isNull(), attributes[x["name"]].isNotNull()).otherwise(F.coalesce(attributes[x["name"]] == x["value"], F.lit(False))),
        )
    )
    value = F.when(F.col("kind") == "attribute", attributes[F.col("attribute")]).otherwise(attributes["style"])
    first = F.min(F.struct("node_idx", "last_idx", value.alias("value")))
    is_text = F.bool_or(F.col("kind") == "text")
    return met.filter(fits).groupBy("page_id", "rule").agg(F.count("*").alias("n"), first.alias("first"), is_text.alias("is_text"))


def _first_texts(nodes: DataFrame, hits: DataFrame) -> DataFrame:
    """(page_id, rule, below): trimmed text of the first match of each text rule."""
    asked = hits.filter("is_text")
    places = asked.select("page_id", F.col("first.node_idx").alias("from"), F.col("first.last_idx").alias("to"))
    texts = nodes.filter(F.col("tag") == "#text").select("page_id", "node_idx", "text")
    inside = places.distinct().join(texts, "page_id").filter((F.col("node_idx") > F.col("from")) & (F.col("node_idx") <= F.col("to")))
    parts = F.array_sort(F.collect_list(F.struct("node_idx", "text")))
    joined = strip_space(F.array_join(F.transform(parts, lambda x: x["text"]), ""))
    texts = inside.groupBy("page_id", "from").agg(joined.alias("below"))
    asked = asked.select("page_id", "rule", F.col("first.node_idx").alias("from"))
    return asked.join(texts, ["page_id", "from"]).select("page_id", "rule", "below")


def check_pages(pages: DataFrame, nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, rule, description, passed, expected, actual, error) of every rule and page it is for.

    ``rules`` has the columns of PAGE_RULES and unique ``rule`` numbers; a null ``page_id``
    is a rule for all ``pages`` (page_id). Kinds: exists, notExists, visible, hidden, count
    (``operator``, ``count``), attribute (``attribute``, ``value``, ``match`` = exact), text
    (``text``, ``match`` = contains). The first match in document order counts. A rule whose
    page is not there, whose selector is not supported or whose kind is unknown has failed.
    """
    is_text = F.col("kind") == "text"
    rules = parsed(rules).withColumns(
        {
            "operator": F.coalesce("operator", F.lit("equal")),
            "match": F.coalesce("match", F.when(is_text, "contains").otherwise("exact")),
            "wanted": F.coalesce(F.when(is_text, F.col("text")).otherwise(F.col("value")), F.lit("")),
        }
    )
    rules = rules.withColumn("valid", (F.col("match") != "regex") | compiles(F.col("wanted")))
    hits = _hits(pages, nodes, rules)
    below = _first_texts(nodes, hits)
    shown = rules.select("rule", "kind", "selector", "operator", "count", "attribute", "match", "wanted", "valid", F.col("sel_key").isNotNull().alias("readable"))
    pairs = _for_all(pages, "page_id", rules, shown)
    pairs = pairs.join(hits.drop("is_text"), ["page_id", "rule"], "left").join(below, ["page_id", "rule"], "left")
    results = pairs.select("page_id", "rule", *[c.alias(n) for n, c in _page_outcome().items()])
    gone = _lost(pages, "page_id", rules).select(
        "page_id", "rule", F.lit("Page should be captured").alias("description"), F.lit(False).alias("passed"),
        F.lit("Capture").alias("expected"), F.lit("Capture not found").alias("actual"), F.lit("Capture not found").alias("error"),
    )
    return results.unionByName(gone)


def _page_outcome() -> dict[str, Column]:
    """The result columns of a page rule, from its columns and its hits."""
    kind, css, n = F.col("kind"), F.col("selector"), F.coalesce("n", F.lit(0))
    there, value = n > 0, F.col("first.value")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    found, none = say("Found ", n, " element(s)"), F.lit("Element not found")
    lost = say('Element "', css, '" not found in DOM')
    hidden = F.coalesce(value.rlike("display: ?none|visibility: ?hidden"), F.lit(False))
    state = F.when(~there, none).when(hidden, "Element is hidden").otherwise("Element is visible")
    count, operator = F.col("count"), F.col("operator")
    compared = {"equal": n == count, "greaterThan": n > count, "lessThan": n < count, "greaterThanOrEqual": n >= count, "lessThanOrEqual": n <= count}
    wanted_n = say(_chosen(operator, {k: F.lit(v) for k, v in SIGNS.items()}, F.lit("?")), " ", count)
    # attribute and text
    wanted, match, valid = F.col("wanted"), F.col("match"), F.col("valid")
    is_text = kind == "text"
    actual = F.when(is_text, F.coalesce("below", F.lit(""))).otherwise(value)
    missing = F.when(~there, none).when(~is_text & value.isNull(), F.lit("Attribute not found"))
    why = F.when(~there, lost).when(~is_text & value.isNull(), say('Attribute "', F.col("attribute"), '" not found on element "', css, '"'))
    subject = F.when(is_text, say('Text content of "', css, '"')).otherwise(say('Attribute "', F.col("attribute"), '" of "', css, '"'))
    mismatch = F.when(is_text, say('Text mismatch for "', css, '"')).otherwise(say('Attribute value mismatch for "', css, '"'))
    full = say(subject, " should ", match, ' "', wanted, '"')
    matched = {
        "description": F.when(valid & missing.isNull(), full).otherwise(subject),
        "passed": there & _cased(actual, wanted, match, valid),
        "expected": wanted,
        "actual": F.coalesce(missing, actual),
        "error": F.coalesce(why, F.when(valid, mismatch).otherwise(say("Invalid regex pattern: ", wanted))),
    }
    cases = {
        "exists": {
            "description": say('Element "', css, '" should exist'), "passed": there, "expected": F.lit("Element exists"),
            "actual": F.when(there, found).otherwise(none), "error": lost,
        },
        "notExists": {
            "description": say('Element "', css, '" should not exist'), "passed": ~there, "expected": F.lit("Element does not exist"),
            "actual": F.when(there, found).otherwise(none), "error": say('Element "', css, '" found in DOM but should not exist'),
        },
        "visible": {
            "description": say('Element "', css, '" should be visible'), "passed": there & ~hidden, "expected": F.lit("Element is visible"),
            "actual": state, "error": F.when(there, say('Element "', css, '" is hidden')).otherwise(lost),
        },
        "hidden": {
            "description": say('Element "', css, '" should be hidden'), "passed": there & hidden, "expected": F.lit("Element is hidden"),
            "actual": state, "error": F.when(there, say('Element "', css, '" is visible but should be hidden')).otherwise(lost),
        },
        "count": {
            "description": say('Count of "', css, '" should be ', wanted_n),
            "passed": F.coalesce(_chosen(operator, compared, F.lit(False)), F.lit(False)), "expected": wanted_n,
            "actual": n.cast("string"), "error": say("Expected count ", wanted_n, ", but got ", n),
        },
        "attribute": matched,
        "text": matched,
    }
    other = {
        "description": say("Rule of kind ", F.coalesce(kind, F.lit("null"))), "passed": F.lit(False), "expected": F.lit("A known kind"),
        "actual": F.lit("Unknown kind"), "error": F.lit("Unknown kind"),
    }
    unread = say("Unsupported selector: ", F.coalesce(css, F.lit("null")))
    out = {}
    for name, fallback in other.items():
        chosen = _chosen(kind, {k: c[name] for k, c in cases.items()}, fallback)
        broken = F.lit(False) if name == "passed" else unread if name in ("actual", "error") else chosen
        out[name] = F.when(F.col("readable"), chosen).otherwise(broken)
    out["error"] = F.when(~out["passed"], out["error"])
    return out


# ---- captures


@F.pandas_udf(StringType())
def _needed(patterns: pd.Series) -> pd.Series:
    """What every match of an expression must hold."""
    return patterns.map(required_literal, na_action="ignore")


def covered(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text, pattern, match): which distinct ``texts`` (text) each of the distinct ``wanted`` (pattern, match) covers.

    Matches are exact, contains (which minds the case) and regex; a broken expression covers nothing.
    """
    texts = texts.select("text").filter("text is not null").distinct()
    wanted = wanted.select("pattern", "match").filter("pattern is not null").distinct()
    exact = texts.join(wanted.filter("match = 'exact'"), F.col("text") == F.col("pattern")).select("text", "pattern", "match")
    expressions = wanted.filter(F.col("match") == "regex").filter(compiles(F.col("pattern"))).withColumn("need", _needed("pattern"))
    plain = wanted.filter("match = 'contains'").withColumn("need", F.col("pattern"))
    looked = plain.unionByName(expressions)
    found = contained(texts.select(F.col("text").alias("key"), "text"), looked.select(F.col("need").alias("literal")).distinct())
    tried = found.join(looked, F.col("literal") == F.col("need")).withColumnRenamed("key", "text")
    tried = tried.filter((F.col("match") == "contains") | F.rlike("text", F.when(F.col("match") == "regex", F.col("pattern")).otherwise("")))
    # nothing to look up: these are tried on every text
    bare = looked.filter("need = ''").agg(F.collect_list(F.struct("pattern", "match"))).scalar()
    every = texts.withColumn("bare", bare).select("text", F.inline("bare"))
    every = every.filter((F.col("match") == "contains") | F.rlike("text", F.col("pattern")))
    return exact.unionByName(tried.select("text", "pattern", "match")).unionByName(every)


def check_captures(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """(collection_id, rule, name, passed, expected, actual, error) of every rule and capture it is for.

    ``rules`` has the columns of LOG_RULES and unique ``rule`` numbers; a null
    ``collection_id`` is a rule for every capture that has entries. Kinds: max_errors and
    max_warnings (``count``), expected and forbidden (``text``, ``level`` or null for any,
    ``match`` = contains). The reported message is the first hit by sequence. A rule whose
    capture is not there, or whose kind is unknown, has failed.
    """
    rules = rules.withColumn("match", F.coalesce("match", F.lit("contains")))
    level = F.col("level")
    counted = entries.groupBy("collection_id").agg(F.count_if(level == "error").alias("errors"), F.count_if(level == "warn").alias("warnings"))
    asked = rules.filter(F.col("kind").isin("expected", "forbidden")).select(
        "rule", "collection_id", F.col("text").alias("pattern"), F.col("level").alias("at"), "match"
    )
    # repeated messages of a capture are one row
    folded = entries.groupBy("collection_id", "level", "message").agg(F.min("seq").alias("seq"))
    pairs = covered(entries.select(F.col("message").alias("text")), asked)
    met = folded.join(pairs, F.col("message") == F.col("text")).drop("text")
    met = met.join(_sought(counted, "collection_id", asked), ["collection_id", "pattern", "match"])
    met = met.filter(F.col("at").isNull() | (F.col("at") == F.col("level")))
    hits = met.groupBy("collection_id", "rule").agg(F.min(F.struct("seq", "message")).alias("hit"))
    todo = _for_all(counted, "collection_id", rules, rules.drop("collection_id"))
    todo = todo.join(counted, "collection_id").join(hits, ["collection_id", "rule"], "left")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    kind, limit, text, message = F.col("kind"), F.col("count"), F.coalesce("text", F.lit("")), F.col("hit.message")
    of = F.when(F.col("level").isNull(), "").otherwise(say(F.col("level"), " "))
    there = F.col("hit").isNotNull()
    cases = {}
    for noun in ("errors", "warnings"):
        n = F.col(noun)
        cases[f"max_{noun}"] = {
            "name": F.lit(f"max_{noun}"), "passed": F.coalesce(n <= limit, F.lit(False)), "expected": say("<= ", limit, f" {noun}"),
            "actual": say(n, f" {noun}"), "error": say("Found ", n, f" {noun}, but maximum allowed is ", limit),
        }
    cases["expected"] = {
        "name": say("expected:", of, text), "passed": there, "expected": text, "actual": F.coalesce(message, say("No matching ", of, "message found")),
        "error": say("Expected ", of, 'message not found: "', text, '"'),
    }
    cases["forbidden"] = {
        "name": say("forbidden:", of, text), "passed": ~there, "expected": F.lit("Message not found"),
        "actual": F.coalesce(message, F.lit("No matching message found")), "error": say("Forbidden ", of, 'message found: "', message, '"'),
    }
    other = {"name": kind, "passed": F.lit(False), "expected": F.lit("A known kind"), "actual": F.lit("Unknown kind"), "error": F.lit("Unknown kind")}
    out = {name: _chosen(kind, {k: c[name] for k, c in cases.items()}, fallback) for name, fallback in other.items()}
    out["error"] = F.when(~out["passed"], out["error"])
    results = todo.select("collection_id", "rule", *[c.alias(n) for n, c in out.items()])
    gone = _lost(counted, "collection_id", rules).select(
        "collection_id", "rule", kind.alias("name"), F.lit(False).alias("passed"), F.lit("Capture").alias("expected"),
        F.lit("Capture not found").alias("actual"), F.lit("Capture not found").alias("error"),
    )
    return results.unionByName(gone)
