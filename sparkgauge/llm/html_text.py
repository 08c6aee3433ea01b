"""Main text of web pages: boosted trees over DOM nodes, decoded from the root down.

A page becomes a tree of block elements; inline elements belong to the block
around them. Gradient-boosted regression trees score every block from its
subtree (text density, link density, tags), attribute tokens, depth, ancestors
and siblings. A node can be kept only with all its ancestors, so the choice is
the best subtree that holds the root: a node's worth is its own score plus that
of its worthwhile children, and a child is kept if it is worth more than nothing.

Training needs no labelled table: pages mark their own parts. Elements such as
``article`` or ``nav`` and tokens such as ``sidebar`` label what they hold. Each
training page counts three times: as it is, with those marks rubbed out, so that
the trees learn the shape of text, and with paragraphs repeated in marked decoys,
so that they learn the marks. The fit uses at most ``max_pages`` pages of at most
``max_page_chars`` characters; extraction reads every whole page, row by row.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgauge.llm.common import keyed_text, slices

# Element names by role, and attribute tokens that name parts of a page.
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul "
    "caption colgroup option select".split()
)
SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video textarea select button datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
GOOD_TAGS, BAD_TAGS = frozenset("article main".split()), frozenset("nav footer aside form header menu dialog search".split())
GOOD_TOKENS = frozenset("article articlebody body content entry main post story text".split())
BAD_TOKENS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright "
    "disclaimer dialog disqus feedback footer form header login masthead menu modal nav navbar navigation newsletter notice notices pagination "
    "pager popup promo promoted promotion recommended related replies respond share sharing sidebar signup social sponsor sponsored subscribe "
    "tags toolbar widget".split()
)
CLOSES = {  # an open element that a start tag ends
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
HEAD = frozenset("head html base basefont bgsound link meta title noscript noframes style script template".split())  # what leaves a head open
SCOPES = frozenset("html body article aside div footer form header main nav section table td th ul ol dl li blockquote".split())

_NAME = re.compile(r"[^\s/>]+")
_GAP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]+")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


class Node:
    """A block element: what it says itself, and where it stands."""

    __slots__ = ("tag", "parent", "depth", "tokens", "hidden", "chars", "links", "punctuation", "inline", "children")

    def __init__(self, tag: str, parent: int, depth: int, tokens: frozenset[str], hidden: bool):
        self.tag, self.parent, self.depth, self.tokens, self.hidden = tag, parent, depth, tokens, hidden
        self.chars = self.links = self.punctuation = self.inline = self.children = 0


def _attributes(pairs: list[tuple[str, str]]) -> tuple[frozenset[str], bool]:
    """Tokens of class, id and role, and whether the element is hidden."""
    tokens, hidden = set(), False
    for name, value in pairs:
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            tokens.update(t.lower() for t in _TOKEN.findall(value))
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return frozenset(tokens), hidden


def scan_tag(page: str, at: int) -> tuple[int, list[tuple[str, str]], bool] | None:
    """(place after the tag, attributes, whether it closes itself) of a tag whose name ends at ``at``.

    One pass, attribute by attribute: a value in quotes ends at its quote, one without at
    white space or ``>`` and may hold quotes. None where the page ends inside the tag.
    """
    pairs: list[tuple[str, str]] = []
    size = len(page)
    while True:
        gap = _GAP.match(page, at)
        at = gap.end()
        if at >= size:
            return None
        if page[at] == ">":
            return at + 1, pairs, gap[0].endswith("/")
        name = _ATTRIBUTE.match(page, at)
        at, value = name.end(), ""
        equals = _EQUALS.match(page, at)
        if equals:
            at = equals.end()
            quote = page[at : at + 1]
            if not quote:
                return None
            if quote in "\"'":
                end = page.find(quote, at + 1)
                if end < 0:
                    return None
                value, at = page[at + 1 : end], end + 1
            elif quote != ">":
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
        pairs.append((name[0].lower(), value))


def after_markup(page: str, at: int) -> int:
    """Place after the comment or declaration that begins at ``at``; the page's end if nothing ends it."""
    if not page.startswith("<!--", at):
        end = page.find(">", at)
        return end + 1 or len(page)
    if page.startswith((">", "->"), at + 4):  # empty ones
        return page.index(">", at) + 1
    ends = [e + len(mark) for mark in ("-->", "--!>") if (e := page.find(mark, at + 4)) >= 0]
    return min(ends, default=len(page))


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes (the root is 0) and runs of text in page order, each with its node.

    Comments, declarations and the content of elements that show no text are left
    out; end tags that open nothing are ignored, missing ones are implied. An open
    head ends where an element or text begins that cannot stand in it. Elements that
    show no text are scopes: what stands in them closes nothing outside. A tag that the
    page's end cuts off is left out with all it swallows.
    """
    nodes = [Node("html", -1, 0, frozenset(), False)]
    runs: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements, blocks with their node, inline ones with the block's
    opened: Counter[str] = Counter(["html"])  # how many of each stand in the stack
    pieces: list[str] = []
    silent, anchors, at, size = 0, 0, 0, len(page)

    def flush() -> None:
        if pieces:
            text = _SPACE.sub(" ", entities.unescape("".join(pieces))).strip(" ")
            if text:
                runs.append((stack[-1][1], text))
            pieces.clear()

    def say(text: str) -> None:
        if stack[-1][0] == "head" and _SPACE.sub("", text):
            close(len(stack) - 1)
        if silent or not text:
            return
        node = nodes[stack[-1][1]]
        n = len(text)
        node.chars += n
        node.links += n if anchors else 0
        node.punctuation += text.count(".") + text.count(",")
        pieces.append(text)

    def close(index: int) -> None:
        nonlocal silent, anchors
        while len(stack) > index:
            tag, _ = stack[-1]
            if tag in BLOCKS and not silent:
                flush()
            silent -= tag in SILENT
            anchors -= tag == "a"
            opened[tag] -= 1
            stack.pop()

    while at < size:
        start = page.find("<", at)
        if start < 0:
            break
        following = page[start + 1 : start + 3]
        ends = following[:1] == "/"
        letter = following[1:] if ends else following[:1]
        if not (letter.isascii() and letter.isalpha()):
            if following[:1] in ("!", "?") or ends and letter:
                say(page[at:start])
                at = after_markup(page, start)
            else:  # no markup: the sign itself
                say(page[at : start + 1])
                at = start + 1
            continue
        say(page[at:start])
        name = _NAME.match(page, start + 1 + ends)
        tag = name[0].lower()
        found = scan_tag(page, name.end())
        if found is None:
            at = size
            break
        at, pairs, closed = found
        if ends:
            if opened[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        close(i)
                        break
                    if (stack[i][0] in SCOPES or stack[i][0] in SILENT) and tag not in SCOPES:
                        break
            continue
        if stack[-1][0] == "head" and tag not in HEAD:
            close(len(stack) - 1)
        if tag == "head" and stack[-1][0] != "html":
            continue
        if tag in ("svg", "math") and closed:
            nodes[stack[-1][1]].inline += 1
            continue
        if tag in ("br", "hr"):
            say(" ")
        if tag in VOID:
            continue
        if tag in BLOCKS:
            enders = CLOSES.get(tag, ())
            if opened["p"] or any(opened[x] for x in enders):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in enders or stack[i][0] == "p":  # no block stands in a paragraph
                        close(i)
                        break
                    if stack[i][0] in SCOPES or stack[i][0] in SILENT:
                        break
            if tag in ("html", "body") and opened[tag]:
                continue
            if not silent:
                flush()
            tokens, hidden = _attributes(pairs)
            parent = stack[-1][1]
            nodes[parent].children += 1
            nodes.append(Node(tag, parent, nodes[parent].depth + 1, tokens, hidden))
            stack.append((tag, len(nodes) - 1))
        else:
            nodes[stack[-1][1]].inline += 1
            stack.append((tag, stack[-1][1]))
            anchors += tag == "a"
        opened[tag] += 1
        silent += tag in SILENT
        if tag in RAW and not closed:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else size
    say(page[at:])
    close(1)
    flush()
    return nodes, runs


NAMES = (
    "chars links punctuation inline children subtree_chars subtree_links subtree_nodes density link_density depth position siblings "
    "sibling_chars sibling_links same_tag good_self bad_self good_above bad_above hidden is_p is_li is_heading is_div share after"
).split()


def node_features(nodes: list[Node], marks: bool = True) -> np.ndarray:
    """One row of ``NAMES`` a node. Without ``marks`` telling tags and attributes are not looked at."""
    n = len(nodes)
    parent = np.array([x.parent for x in nodes])
    base = np.array([(x.chars, x.links, x.punctuation, x.inline, x.children, x.depth) for x in nodes], float).T
    chars, links, punctuation, inline, children, depth = base
    sub = np.stack([chars.copy(), links.copy(), np.ones(n)])
    for i in range(n - 1, 0, -1):  # children come after their parents
        sub[:, parent[i]] += sub[:, i]
    above = np.maximum(parent, 0)
    kids = np.bincount(above[1:], minlength=n).astype(float)
    kid_chars = np.bincount(above[1:], weights=sub[0, 1:], minlength=n)
    kid_links = np.bincount(above[1:], weights=sub[1, 1:], minlength=n)
    seen, position = {}, np.zeros(n)
    for i in range(1, n):
        position[i] = seen.get(parent[i], 0)
        seen[parent[i]] = position[i] + 1
    siblings = np.maximum(kids[above] - 1, 0)
    sib_chars = (kid_chars[above] - sub[0]) / np.maximum(siblings, 1)
    sib_links = (kid_links[above] - sub[1]) / np.maximum(kid_chars[above] - sub[0], 1)
    same: dict[tuple[int, str], int] = {}
    for x in nodes:
        same[x.parent, x.tag] = same.get((x.parent, x.tag), 0) + 1
    good, bad = np.zeros(n), np.zeros(n)
    hidden = np.array([x.hidden for x in nodes], float)
    if marks:
        good = np.array([(x.tag in GOOD_TAGS) + len(x.tokens & GOOD_TOKENS) for x in nodes], float)
        bad = np.array([(x.tag in BAD_TAGS) + len(x.tokens & BAD_TOKENS) for x in nodes], float)
    good_above, bad_above = np.zeros(n), np.zeros(n)
    for i in range(1, n):
        p = parent[i]
        good_above[i] = good_above[p] + good[p]
        bad_above[i] = max(bad_above[p] + bad[p], 0)
        hidden[i] = max(hidden[i], hidden[p])
    tag = [x.tag for x in nodes]
    flag = lambda names: np.array([t in names for t in tag], float)
    rows = [
        np.log1p(chars), links / np.maximum(chars, 1), punctuation / np.maximum(chars, 1), inline, children, np.log1p(sub[0]),
        np.log1p(sub[1]), np.log1p(sub[2]), np.log1p(sub[0] / sub[2]), sub[1] / np.maximum(sub[0], 1), depth, position, siblings,
        np.log1p(sib_chars), sib_links, np.array([same[x.parent, x.tag] for x in nodes], float), good, bad, good_above, bad_above, hidden,
        flag({"p", "pre", "blockquote"}), flag({"li", "dd", "dt"}), flag({"h1", "h2", "h3", "h4", "h5", "h6"}), flag({"div", "section"}),
        sub[0] / max(1.0, sub[0, 0]), siblings - position,
    ]
    return np.stack(rows, 1)


def weak_labels(nodes: list[Node]) -> np.ndarray:
    """1 for nodes that a page marks as its text, 0 for those it marks as something else, -1 for the rest.

    The mark nearest above counts, except that nothing inside a part marked as other is text again.
    """
    out = np.full(len(nodes), -1)
    for i, x in enumerate(nodes):
        inherited = out[x.parent] if x.parent >= 0 else -1
        if inherited == 0 or x.hidden or x.tag in BAD_TAGS and not (x.tag == "header" and inherited == 1) or x.tokens & BAD_TOKENS:
            out[i] = 0
        elif x.tag in GOOD_TAGS or x.tokens & {"article", "articlebody"}:
            out[i] = 1
        else:
            out[i] = inherited
    return out


@dataclass(frozen=True)
class BoostedTrees:
    """Trees of fixed depth as arrays; a leaf is found by ``depth`` comparisons."""

    base: float
    depth: int
    feature: np.ndarray  # tree x inner node
    threshold: np.ndarray
    leaf: np.ndarray  # tree x leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds that a node is text."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            total += leaf[at - (len(f))]
        return total


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 32) -> BoostedTrees:
    """Second-order boosting of the logistic loss over histogram bins."""
    p = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
    inner = (1 << depth) - 1
    feature, threshold, leaf = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    score = np.full(len(x), base)
    for k in range(trees):
        q = 1 / (1 + np.exp(-score))
        g, h = weight * (y - q), weight * q * (1 - q)
        at = np.zeros(len(x), int)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best, split = 1e-9, None
            if len(rows) > 1:
                total_g, total_h = g[rows].sum(), h[rows].sum()
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    left_g = np.cumsum(np.bincount(binned[rows, f], g[rows], len(e) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(binned[rows, f], h[rows], len(e) + 1))[:-1]
                    gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                    j = int(gain.argmax())
                    if gain[j] > best:
                        best, split = gain[j], (f, e[j], j)
            if split:
                feature[k, node], threshold[k, node] = split[0], split[1]
                at[rows] = 2 * node + 1 + (binned[rows, split[0]] > split[2])
            else:
                at[rows] = 2 * node + 1
        for j in range(inner + 1):
            rows = at == inner + j
            leaf[k, j] = rate * g[rows].sum() / (h[rows].sum() + 1)
        score += leaf[k][at - inner]
    return BoostedTrees(base, depth, feature, threshold, leaf)


def decode(nodes: list[Node], score: np.ndarray) -> np.ndarray:
    """The nodes of the best subtree that holds the root.

    Own text weighs by its length (square root), a node without text little: then no
    kept node stands in a dropped one, and a doubtful child follows its surroundings.
    """
    weight = np.array([0.1 + np.sqrt(x.chars) for x in nodes])
    worth = score * weight
    for i in range(len(nodes) - 1, 0, -1):
        worth[nodes[i].parent] += max(0.0, worth[i])
    keep = np.ones(len(nodes), bool)
    for i in range(1, len(nodes)):
        keep[i] = keep[nodes[i].parent] and worth[i] > 0
    return keep


def main_text(page: str, model: BoostedTrees) -> str:
    """Kept blocks in page order, joined by one space."""
    nodes, runs = parse(page)
    if not runs:
        return ""
    keep = decode(nodes, model.score(node_features(nodes)))
    return " ".join(text for node, text in runs if keep[node])


def with_decoys(page: str) -> str:
    """The page with its own paragraphs repeated in parts that are marked as something else, and the
    text itself in a plain marked block: then only the marks tell one from the other."""
    nodes, runs = parse(page)
    label = weak_labels(nodes)
    texts = [entities.escape(t) for node, t in runs if label[node] == 1][-6:]
    if not texts:
        return page
    bad, tags = sorted(BAD_TOKENS), ("div", "section", "ul", "form", "aside")
    start = len(page)  # names differ from page to page, and do not depend on the order of pages

    def decoy(k: int) -> str:
        tag, name = tags[(start + k) % len(tags)], bad[(start * 7 + k * 13) % len(bad)]
        inner = "".join(f"<p>{t}</p>" for t in texts[k % 3 :: 2]) or f"<p>{texts[0]}</p>"
        return f"<{tag}{'' if tag in BAD_TAGS else f' class={name}'}>{inner}</{tag}>"

    good = sorted(GOOD_TOKENS)[start % len(GOOD_TOKENS)]
    body = re.sub(r"<(/?)(article|main)\b", lambda m: f"<{m[1]}div" + ("" if m[1] else f' class="{good} article"'), page)
    head, mark, rest = body.partition("<body>")
    return head + mark + decoy(0) + rest.replace("</body>", decoy(1) + decoy(2) + "</body>")


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for page in batch.column(0).to_pylist():
            for variant, marks in ((page, True), (page, False), (with_decoys(page), True)):
                nodes, _ = parse(variant)
                y = weak_labels(nodes)
                own = np.flatnonzero((y >= 0) & (np.array([x.chars for x in nodes]) > 0))
                if len(own):
                    rows = node_features(nodes, marks)[own]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(y[own], pa.int64())], ["x", "y"]
                    )


def train(pages: DataFrame, key: str = "page_id", html: str = "html", max_pages: int = 400, max_page_chars: int = 60_000) -> BoostedTrees:
    """Fit on the pages with the smallest hash of their key among those of bounded length.

    Features of at most ``max_pages`` pages reach the driver. Without a page that marks
    its parts, every node counts as text.
    """
    rows = keyed_text(pages, key, html).filter(F.length("text").between(1, max_page_chars))
    total = rows.count()
    scale = 1 << 30
    bound = scale if total <= max_pages else max_pages * scale // total
    drawn = rows.filter(F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit(3)), F.lit(scale)) < bound).limit(2 * max_pages)
    got = drawn.select("text").mapInArrow(_training_rows, "x binary, y long").toArrow()
    y = got["y"].to_numpy().astype(float)
    x = np.frombuffer(b"".join(got["x"].to_pylist()), float).reshape(-1, len(NAMES))
    if not len(y) or y.min() == y.max():
        return BoostedTrees(1.0, 1, np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)))
    order = np.lexsort((x @ np.linspace(1, 2, x.shape[1]), y))  # whatever order tasks end in
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    return fit_trees(x[order], y[order], weight[order])


def extract(pages: DataFrame, model: BoostedTrees, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) for every row: whole pages, no shuffle.

    A null or empty page, and one without text, gives an empty text. Repeated rows give
    repeated results; other columns are neither read nor returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = [main_text(p or "", model) for p in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["key", "url", "text", "n_chars"],
                )

    rows = keyed_text(pages, key, html, url)
    kinds = [f.dataType.simpleString() for f in rows.schema.fields]
    return rows.mapInArrow(run, f"key {kinds[0]}, url {kinds[2]}, text string, n_chars long").select(
        F.col("key").alias(key), F.col("url").alias(url), "text", "n_chars"
    )
