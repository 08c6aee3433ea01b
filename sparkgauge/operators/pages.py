"""Web pages as node tables: parsing, selectors, checks, links and text.

The tree comes from the standard library parser and a small set of implied end tags; it is
not a browser's tree. Nodes are (page_id, node_idx, parent_idx, last_idx, depth, tag,
attributes, text, in_body, parent_tag, chunk) in document order; ``last_idx`` is the last
node of the subtree, so a subtree is a range of indexes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgauge.functions.patterns import is_valid_regex, matches_cased
from sparkgauge.functions.textfns import strip_space

CHUNK_NODES = 1000  # fixed value: nodes per stored chunk
# Fixed values of HTML: elements without content, and open elements a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSED_BY = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option"]),
    "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
}
SCOPES = frozenset("html body table ul ol dl select button object template".split())

NODE_SCHEMA = (
    "page_id long, node_idx int, parent_idx int, last_idx int, depth int, tag string,"
    "attributes map<string,string>, text string, in_body boolean, parent_tag string"
)


class _Nodes(HTMLParser):
    """Collects one page as rows; text is kept raw, blank text joins the text before it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []

    def _add(self, tag: str, attributes: list | None, text: str | None) -> int:
        parent = self.open[-1] if self.open else None
        in_body = tag == "body" or (parent is not None and self.rows[parent][7])
        idx = len(self.rows)
        parent_tag = self.rows[parent][4] if parent is not None else None
        self.rows.append([idx, parent, idx, len(self.open), tag, attributes, text, in_body, parent_tag])
        return idx

    def _close(self, upto: int) -> None:
        for idx in self.open[upto:]:
            self.rows[idx][2] = len(self.rows) - 1
        del self.open[upto:]

    def _closed_by(self, tag: str) -> int | None:
        """Depth of the innermost open element that this start tag ends, within its scope."""
        for depth in range(len(self.open) - 1, -1, -1):
            name = self.rows[self.open[depth]][4]
            if tag in CLOSED_BY.get(name, ()):
                return depth
            if name in SCOPES:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        while (depth := self._closed_by(tag)) is not None:
            self._close(depth)
        idx = self._add(tag, list({k: v or "" for k, v in reversed(attrs)}.items()), None)
        if tag not in VOID:
            self.open.append(idx)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[depth]][4] == tag:
                self._close(depth)
                return

    def handle_data(self, data):
        last = self.rows[-1] if self.rows else None
        glue = last is not None and last[4] == "#text" and (not data.strip() or last[1] == (self.open[-1] if self.open else None))
        if glue:
            last[6] += data
        elif data.strip():
            self._add("#text", None, data)

    def finish(self) -> list[list]:
        self.close()
        self._close(0)
        return self.rows


NODE_FIELDS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("node_idx", pa.int32()),
        ("parent_idx", pa.int32()),
        ("last_idx", pa.int32()),
        ("depth", pa.int32()),
        ("tag", pa.string()),
        ("attributes", pa.map_(pa.string(), pa.string())),
        ("text", pa.string()),
        ("in_body", pa.bool_()),
        ("parent_tag", pa.string()),
    ]
)
BATCH_NODES = 20_000


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parse page by page; a batch leaves once it holds ``BATCH_NODES`` nodes."""

    def packed(rows: list[list]) -> pa.RecordBatch:
        columns = zip(*rows)
        arrays = [pa.array(list(c), f.type) for c, f in zip(columns, NODE_FIELDS)]
        return pa.RecordBatch.from_arrays(arrays, schema=NODE_FIELDS)

    rows: list[list] = []
    for batch in batches:
        for page_id, markup in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()):
            parser = _Nodes()
            parser.feed(markup)
            rows.extend([page_id, *row] for row in parser.finish())
            if len(rows) >= BATCH_NODES:
                yield packed(rows)
                rows = []
    if rows:
        yield packed(rows)


def html_nodes(pages: DataFrame) -> DataFrame:
    """Node rows of each page. A page is parsed where it lies: no shuffle, one page at a time.

    Parsing is the costly step, so write the nodes as a table when several jobs read them.
    """
    source = pages.select("page_id", "html").filter(F.col("html").isNotNull())
    nodes = source.mapInArrow(_parse, NODE_SCHEMA)
    return nodes.withColumn("chunk", F.floor(F.col("node_idx") / CHUNK_NODES).cast("int"))


def page_stats(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes, chunks, title and url per page."""
    is_title = (F.col("tag") == "#text") & (F.col("parent_tag") == "title")
    counted = nodes.groupBy("page_id").agg(
        F.count("*").alias("nodes"),
        (F.max("chunk") + 1).cast("long").alias("chunks"),
        strip_space(F.min_by("text", F.when(is_title, F.col("node_idx")))).alias("title"),
    )
    return pages.select("page_id", "url").join(counted, "page_id")


# ---- selectors


def selector(text: str) -> Column:
    """Predicate of a compound selector: ``tag``, ``#id``, ``.class``, ``[attr]``, ``[attr=value]``.

    Combinators are not supported and raise.
    """
    part = r"""[#.][\w-]+|\[[\w-]+(?:=(?:"[^"]*"|'[^']*'|[^\]]*))?\]"""
    found = re.fullmatch(rf"([a-zA-Z][\w-]*|\*)?((?:{part})*)", text.strip())
    if not found or not text.strip():
        raise ValueError(f"unsupported selector {text!r}")
    test = F.col("tag") != "#text"
    if found[1] and found[1] != "*":
        test = F.col("tag") == found[1].lower()
    for piece in re.findall(part, found[2] or ""):
        if piece[0] == "#":
            one = F.col("attributes")["id"] == piece[1:]
        elif piece[0] == ".":
            one = F.array_contains(F.split(F.col("attributes")["class"], r"\s+"), piece[1:])
        else:
            name, has_value, value = piece[1:-1].partition("=")
            attr = F.col("attributes")[name]
            one = attr == value.strip("\"'") if has_value else attr.isNotNull()
        test = test & F.coalesce(one, F.lit(False))
    return test


def _page_texts() -> Column:
    """Aggregate: the text nodes of a page; as large as the page, which is one input value."""
    return F.array_sort(F.collect_list(F.when(F.col("tag") == "#text", F.struct("node_idx", "text"))))


def _text_below(texts: Column, node: Column) -> Column:
    """Trimmed text of the subtree of ``node`` (node_idx, last_idx)."""
    inside = F.filter(texts, lambda x: (x["node_idx"] > node["node_idx"]) & (x["node_idx"] <= node["last_idx"]))
    return strip_space(F.array_join(F.transform(inside, lambda x: x["text"]), ""))


def begin_of() -> Column:
    """Place of a node's beginning among all beginnings and ends of its page, counted from 0.

    Of the nodes before it, its ancestors have only begun and all others have ended too.
    """
    return F.col("node_idx") * 2 - F.col("depth")


def end_of() -> Column:
    """Place of a node's end: every node of the subtree has two places between."""
    return begin_of() + (F.col("last_idx") - F.col("node_idx")) * 2 + 1


# Fixed values of HTML: what is written for a character in text and in attribute values, and elements with raw text.
IN_TEXT = {"&": "&amp;", "\u00a0": "&nbsp;", "<": "&lt;", ">": "&gt;"}
IN_VALUE = {"&": "&amp;", "\u00a0": "&nbsp;", '"': "&quot;"}
RAW_TEXT = ["script", "style", "xmp", "iframe", "noembed", "noframes", "plaintext"]


def _written(text: Column, table: dict[str, str]) -> Column:
    for char, name in table.items():
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def _tags() -> tuple[Column, Column]:
    """What a node writes at its beginning and at its end."""
    pairs = F.transform(
        F.reverse(F.map_entries("attributes")), lambda a: F.concat(F.lit(" "), a["key"], F.lit('="'), _written(a["value"], IN_VALUE), F.lit('"'))
    )
    is_text, raw = F.col("tag") == "#text", F.coalesce(F.col("parent_tag").isin(RAW_TEXT), F.lit(False))
    opened = F.concat(F.lit("<"), "tag", F.coalesce(F.array_join(pairs, ""), F.lit("")), F.lit(">"))
    closed = F.concat(F.lit("</"), "tag", F.lit(">"))
    first = F.when(is_text & raw, F.col("text")).when(is_text, _written(F.col("text"), IN_TEXT)).otherwise(opened)
    return first, F.when(is_text | F.col("tag").isin(sorted(VOID)), "").otherwise(closed)


def select_nodes(nodes: DataFrame, css: str) -> DataFrame:
    """Matches of a selector: (page_id, node_idx, tag, attributes, text, html).

    ``text`` is the trimmed text below, ``html`` what stands inside the element. Every node
    has the interval (``begin_of``, ``end_of``) of places in its page; what is inside an
    element is the run of places inside its interval, so nothing walks the tree.
    """
    first, last = _tags()
    text = F.when(F.col("tag") == "#text", F.col("text")).otherwise("")
    at_begin = F.struct(begin_of().alias("at"), first.alias("html"), text.alias("text"))
    at_end = F.struct(end_of().alias("at"), last.alias("html"), F.lit("").alias("text"))
    hit = F.struct("node_idx", "tag", F.to_json("attributes").alias("attributes"), begin_of().alias("begin"), end_of().alias("end"))
    pages = nodes.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.when(selector(css), hit))).alias("_hits"),
        F.array_sort(F.flatten(F.collect_list(F.array(at_begin, at_end)))).alias("_places"),
    )
    rows = pages.filter(F.size("_hits") > 0).select("page_id", "_places", F.inline("_hits"))
    inside = F.slice("_places", F.col("begin") + 2, F.col("end") - F.col("begin") - 1)
    return rows.select(
        "page_id",
        "node_idx",
        "tag",
        "attributes",
        strip_space(F.array_join(F.transform(inside, lambda x: x["text"]), "")).alias("text"),
        F.array_join(F.transform(inside, lambda x: x["html"]), "").alias("html"),
    )


# ---- checks: rules compile to conditional aggregates over one pass of the nodes

OPERATORS = {
    "equal": ("=", lambda a, b: a == b),
    "greaterThan": (">", lambda a, b: a > b),
    "lessThan": ("<", lambda a, b: a < b),
    "greaterThanOrEqual": (">=", lambda a, b: a >= b),
    "lessThanOrEqual": ("<=", lambda a, b: a <= b),
}


def _outcome(i: int, description: str | Column, passed: Column, expected: str, actual: Column | str, error: Column) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        F.lit(i).alias("rule"),
        as_column(description).alias("description"),
        passed.alias("passed"),
        F.lit(expected).alias("expected"),
        as_column(actual).cast("string").alias("actual"),
        F.when(~passed, error).alias("error"),
    )


def assert_nodes(nodes: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """Check every page against every rule: (page_id, rule, description, passed, expected, actual, error).

    Rule kinds: exists, notExists, visible, hidden, count (``operator``, ``count``),
    attribute (``attribute``, ``value``, ``match`` = exact), text (``text``, ``match`` =
    contains). The first match in document order counts.
    """
    aggs = []
    for i, rule in enumerate(rules):
        hit = selector(rule["selector"])
        attributes = F.col("attributes")
        value = attributes[rule["attribute"]] if rule["kind"] == "attribute" else attributes["style"]
        aggs.append(F.count_if(hit).alias(f"n{i}"))
        aggs.append(F.min(F.when(hit, F.struct("node_idx", "last_idx", value.alias("value")))).alias(f"f{i}"))
    texts = [i for i, r in enumerate(rules) if r["kind"] == "text"]
    if texts:
        aggs.append(_page_texts().alias("_texts"))
    firsts = nodes.groupBy("page_id").agg(*aggs)
    below = [_text_below(F.col("_texts"), F.col(f"f{i}")).alias(f"t{i}") for i in texts]
    firsts = firsts.select(*[c for c in firsts.columns if c != "_texts"], *below)
    results = [_check(i, r) for i, r in enumerate(rules)]
    return firsts.select("page_id", F.inline(F.array(*results)))


def _check(i: int, rule: dict) -> Column:
    css, kind = rule["selector"], rule["kind"]
    n, value = F.col(f"n{i}"), F.col(f"f{i}.value")
    there = n > 0
    found = F.concat(F.lit("Found "), n, F.lit(" element(s)"))
    lost = F.lit(f'Element "{css}" not found in DOM')
    if kind == "exists":
        actual = F.when(there, found).otherwise("Element not found")
        return _outcome(i, f'Element "{css}" should exist', there, "Element exists", actual, lost)
    if kind == "notExists":
        actual = F.when(there, found).otherwise("Element not found")
        error = F.lit(f'Element "{css}" found in DOM but should not exist')
        return _outcome(i, f'Element "{css}" should not exist', ~there, "Element does not exist", actual, error)
    if kind in ("visible", "hidden"):
        is_hidden = F.coalesce(value.rlike("display: ?none|visibility: ?hidden"), F.lit(False))
        passed = there & (is_hidden if kind == "hidden" else ~is_hidden)
        state = F.when(is_hidden, "Element is hidden").otherwise("Element is visible")
        wrong = f'Element "{css}" is hidden' if kind == "visible" else f'Element "{css}" is visible but should be hidden'
        actual = F.when(there, state).otherwise("Element not found")
        error = F.when(there, F.lit(wrong)).otherwise(lost)
        return _outcome(i, f'Element "{css}" should be {kind}', passed, f"Element is {kind}", actual, error)
    if kind == "count":
        symbol, test = OPERATORS[rule.get("operator", "equal")]
        wanted = f"{symbol} {rule['count']}"
        error = F.concat(F.lit(f"Expected count {wanted}, but got "), n)
        return _outcome(i, f'Count of "{css}" should be {wanted}', test(n, F.lit(rule["count"])), wanted, n, error)
    if kind == "attribute":
        name, wanted, match = rule["attribute"], rule["value"], rule.get("match", "exact")
        subject, actual = f'Attribute "{name}" of "{css}"', value
        missing = F.when(~there, F.lit("Element not found")).when(value.isNull(), F.lit("Attribute not found"))
        why = F.when(~there, lost).when(value.isNull(), F.lit(f'Attribute "{name}" not found on element "{css}"'))
        mismatch = f'Attribute value mismatch for "{css}"'
    elif kind == "text":
        wanted, match = rule["text"], rule.get("match", "contains")
        subject, actual = f'Text content of "{css}"', F.coalesce(F.col(f"t{i}"), F.lit(""))
        missing, why = F.when(~there, F.lit("Element not found")), F.when(~there, lost)
        mismatch = f'Text mismatch for "{css}"'
    else:
        raise ValueError(f"unknown rule kind {kind!r}")
    broken = match == "regex" and not is_valid_regex(wanted)
    passed = F.coalesce(there & matches_cased(actual, wanted, match), F.lit(False))
    full = f'{subject} should {match} "{wanted}"'
    description = F.lit(subject) if broken else F.when(missing.isNull(), full).otherwise(subject)
    error = F.coalesce(why, F.lit(f"Invalid regex pattern: {wanted}" if broken else mismatch))
    return _outcome(i, description, passed, wanted, F.coalesce(missing, actual), error)


# ---- links and text


def _without_dots(url: Column) -> Column:
    """``/./`` goes, ``/../`` takes the segment before along; the origin stays."""
    head = F.regexp_extract(url, r"^([a-zA-Z][\w+.-]*:(?://[^/?#]*)?)", 1)
    rest = F.substr(url, F.length(head) + 1)
    path = F.regexp_extract(rest, r"^[^?#]*", 0)
    parts = F.slice(F.split(path, "/"), F.lit(2), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        shorter = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == ".", done).when(part == "..", shorter).otherwise(F.concat(done, F.array(part)))

    kept = F.aggregate(parts, none, step)
    folder = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(head, F.lit("/"), F.array_join(folder, "/"), F.substr(rest, F.length(path) + 1))


def resolve_url(href: Column, base: Column) -> Column:
    """Absolute form of a link on a page, with ``.`` and ``..`` segments resolved."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*:)", 1)
    plain = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(F.length(plain) == F.length(origin), F.concat(origin, F.lit("/"))).otherwise(
        F.regexp_replace(plain, r"[^/]*$", "")
    )
    whole = (
        F.when(href.rlike(r"^[a-zA-Z][\w+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(plain, href))
        .when(href == "", F.regexp_replace(base, "#.*$", ""))
        .otherwise(F.concat(folder, href))
    )
    return F.when(whole.rlike(r"^[^?#]*/\.\.?([/?#]|$)"), _without_dots(whole)).otherwise(whole)


def _urls(pages: DataFrame, nodes: DataFrame, tag: str, attribute: str) -> DataFrame:
    hits = nodes.filter((F.col("tag") == tag) & F.col("attributes")[attribute].isNotNull())
    hits = hits.select("page_id", "node_idx", F.col("attributes")[attribute].alias("raw"))
    base = pages.select("page_id", F.col("url").alias("_base"))
    return hits.join(base, "page_id").select("page_id", "node_idx", "raw", resolve_url(F.col("raw"), F.col("_base")).alias("url"))


def extract_links(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    return _urls(pages, nodes, "a", "href")


def extract_images(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    return _urls(pages, nodes, "img", "src")


def page_text(nodes: DataFrame) -> DataFrame:
    """Body text in document order, one line per text node, without script and style."""
    seen = nodes.filter((F.col("tag") == "#text") & F.col("in_body") & ~F.col("parent_tag").isin("script", "style"))
    parts = F.array_sort(F.collect_list(F.struct("node_idx", strip_space(F.col("text")).alias("t"))))
    return seen.groupBy("page_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("text"))
