"""Benchmark decontamination with a positional inverted index.

The index holds, for runs of documents (segments), the postings of every term
that the test items use: term by term, the sorted positions in the segment.
Segments are rows of a stored table; building one and searching one is the
work of one task, so nothing is shuffled but results of several item blocks.

A search takes the phrases (windows of the items) and, from each phrase's
rarest term over the whole corpus, intersects offset-adjusted posting lists in
order of rarity. Proximity search starts from the rarest term the same way.

Items travel to the tasks in blocks of at most ``block_words`` words, so what
is broadcast is bounded; every block searches all documents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgauge.llm.common import by_slices, keyed_text, stored, text_bytes

WINDOW = 13

# Word bytes: digits, letters and everything beyond ASCII; capitals become small, the rest spaces.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass(frozen=True)
class Phrases:
    """Phrases of a block of items as term numbers, row by row, -1 after the end."""

    vocabulary: dict[bytes, int]
    terms: np.ndarray  # phrase x position
    lengths: np.ndarray
    item: np.ndarray  # index into ids, by phrase
    ids: list  # item ids as text; None for an item without id


def phrases_of(items: Sequence[tuple[str | None, str | None]], window: int = WINDOW) -> Phrases:
    """Windows of ``window`` words; an item of fewer words, but not none, is one window."""
    vocabulary: dict[bytes, int] = {}
    rows, lengths, owner, seen = [], [], [], set()
    for k, (_, text) in enumerate(items):
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of((text or "").encode())]
        size = min(window, len(ids))
        for i in range(len(ids) - size + 1 if ids else 0):
            row = (*ids[i : i + size], *[-1] * (window - size))
            if (k, row) not in seen:
                seen.add((k, row))
                rows.append(row)
                lengths.append(size)
                owner.append(k)
    return Phrases(
        vocabulary,
        np.array(rows, np.int64).reshape(-1, window),
        np.array(lengths, np.int64),
        np.array(owner, np.int64),
        [i for i, _ in items],
    )


INDEX = "keys array<{kind}>, words array<int>, terms array<int>, counts array<int>, positions binary"


def _index(vocabulary):
    """Segment rows. A document starts one position after the end of the one before, so no phrase crosses."""

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        get = vocabulary.value.get
        raw, offsets = text_bytes(part.column(1))
        raw = raw.tobytes()
        found, sizes = [], []
        for a, b in zip(offsets[:-1], offsets[1:]):
            words = raw[a:b].translate(_FOLD).split()
            found.append(np.fromiter((get(w, -1) for w in words), np.int64, len(words)))
            found.append(np.full(1, -1))
            sizes.append(len(words))
        ids = np.concatenate(found)
        at = np.flatnonzero(ids >= 0)
        order = np.argsort(ids[at], kind="stable")
        terms, counts = np.unique(ids[at], return_counts=True)
        lists = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
        yield pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), part.column(0)),
                lists(sizes, pa.int32()),
                lists(terms, pa.int32()),
                lists(counts, pa.int32()),
                pa.array([at[order].astype(np.int32).tobytes()], pa.binary()),
            ],
            ["keys", "words", "terms", "counts", "positions"],
        )

    return by_slices(work)


def build_index(docs: DataFrame, vocabulary) -> DataFrame:
    """The stored index of rows (key, text) over the terms of a broadcast vocabulary."""
    kind = docs.schema["key"].dataType.simpleString()
    return stored(docs.select("key", "text").mapInArrow(_index(vocabulary), INDEX.format(kind=kind)), "postings", compression="zstd")


def term_counts(index: DataFrame, size: int) -> np.ndarray:
    """Postings of each term over all documents; as many rows as the block has terms."""
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("p"))
    found = pairs.groupBy("p.terms").agg(F.sum("p.counts").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found["terms"].to_numpy()] = found["n"].to_numpy()
    return out


class Segment:
    """Posting lists of one row of the index."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, size: int):
        self.first = np.zeros(size + 1, np.int64)
        self.first[terms + 1] = counts
        np.cumsum(self.first, out=self.first)
        self.positions = positions.astype(np.int64)
        self.keys = np.repeat(np.arange(size), np.diff(self.first)) << 32 | self.positions

    def has(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether a term stands at a position."""
        want = terms << 32 | positions
        at = np.searchsorted(self.keys, want)
        at[at == len(self.keys)] = 0
        return (positions >= 0) & (self.keys[at] == want) if len(self.keys) else np.zeros(len(want), bool)

    def expand(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each entry of ``terms`` all its positions: index of the entry, position."""
        counts = self.first[terms + 1] - self.first[terms]
        entry = np.repeat(np.arange(len(terms)), counts)
        skip = np.repeat(np.cumsum(counts) - counts, counts)
        return entry, self.positions[np.repeat(self.first[terms], counts) + np.arange(len(entry)) - skip]

    def phrases(self, terms: np.ndarray, lengths: np.ndarray, rank: np.ndarray, limit: int = 1 << 21):
        """(phrase, position) of each exact occurrence. ``rank``: offsets of a phrase, rarest term first."""
        rows = np.arange(len(terms))
        anchor = terms[rows, rank[:, 0]]
        cost = np.cumsum(self.first[anchor + 1] - self.first[anchor])
        out_p, out_at, start = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        while start < len(rows):  # so many phrases at a time that the candidates stay bounded
            base = cost[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(cost, base + limit, "right")))
            entry, at = self.expand(anchor[start:end])
            phrase = entry + start
            at = at - rank[phrase, 0]
            for step in range(1, terms.shape[1]):
                more = step < lengths[phrase]
                offset = rank[phrase, step]
                ok = ~more | self.has(terms[phrase, offset], at + offset)
                phrase, at = phrase[ok], at[ok]
            out_p.append(phrase)
            out_at.append(at)
            start = end
        return np.concatenate(out_p), np.concatenate(out_at)

    def near(self, terms: Sequence[int], counts: np.ndarray, within: int) -> np.ndarray:
        """Positions of the rarest term that have every other term at most ``within`` words away."""
        order = sorted(terms, key=lambda t: (counts[t], t))
        at = self.positions[self.first[order[0]] : self.first[order[0] + 1]]
        for t in order[1:]:
            own = self.positions[self.first[t] : self.first[t + 1]]
            if not len(own) or not len(at):
                return at[:0]
            i = np.searchsorted(own, at)
            left = np.abs(at - own[np.maximum(i - 1, 0)])
            right = np.abs(own[np.minimum(i, len(own) - 1)] - at)
            at = at[np.minimum(left, right) <= within]
        return at


def _segments(batch: pa.RecordBatch, size: int):
    for i in range(batch.num_rows):
        row = [batch.column(k)[i] for k in range(5)]
        words = row[1].values.to_numpy()
        starts = np.concatenate([[0], np.cumsum(words + 1)]).astype(np.int64)
        positions = np.frombuffer(row[4].as_py(), np.int32)
        yield row[0].values, words, starts, Segment(row[2].values.to_numpy().astype(np.int64), row[3].values.to_numpy(), positions, size)


def rarest_first(phrases: Phrases, counts: np.ndarray) -> np.ndarray:
    """Offsets of each phrase ordered by how rare the term there is; offsets after the end last."""
    cost = np.where(phrases.terms >= 0, counts[np.maximum(phrases.terms, 0)], np.iinfo(np.int64).max)
    return np.argsort(cost, axis=1, kind="stable")


def _search(phrases, counts):
    """Per document: words, runs of hit words (start, end), ids of items that occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = phrases.value
        rank = rarest_first(p, counts.value)
        for batch in batches:
            for keys, words, starts, segment in _segments(batch, len(p.vocabulary)):
                phrase, at = segment.phrases(p.terms, p.lengths, rank)
                cover = np.zeros(starts[-1] + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + p.lengths[phrase], -1)
                inside = np.cumsum(cover) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
                first, last = edge[::2], edge[1::2]
                owner = np.searchsorted(starts, first, "right") - 1
                pairs = np.unique(np.stack([np.searchsorted(starts, at, "right") - 1, p.item[phrase]], 1), axis=0)
                split = np.searchsorted(owner, np.arange(len(words) + 1))
                listed = [[] for _ in words]
                for d, k in pairs:
                    if p.ids[k] is not None:
                        listed[d].append(p.ids[k])
                offsets = pa.array(split, pa.int32())
                base = starts[owner]
                yield pa.RecordBatch.from_arrays(
                    [
                        keys,
                        pa.array(words.astype(np.int64)),
                        pa.ListArray.from_arrays(offsets, pa.array(first - base, pa.int64())),
                        pa.ListArray.from_arrays(offsets, pa.array(last - base, pa.int64())),
                        pa.array([sorted(set(x)) for x in listed], pa.list_(pa.string())),
                    ],
                    ["key", "n_words", "hit_from", "hit_to", "items"],
                )

    return run


def _blocks(items: DataFrame, key: str, text: str, block_words: int) -> tuple[int, Iterator[list]]:
    """How many blocks of about ``block_words`` words the items make, and the blocks, dealt by a hash of text and id."""
    rows = keyed_text(items, key, text).select(F.col("key").cast("string").alias("key"), "text").filter("text is not null")
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // (4 * block_words)))

    def block(k: int) -> list:
        part = rows.filter(F.pmod(F.xxhash64("key", "text"), F.lit(n)) == k) if n > 1 else rows
        return [(r[0], r[1]) for r in part.collect()]

    return n, map(block, range(n))


def find_phrases(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                 item_text: str = "text", window: int = WINDOW, block_words: int = 2_000_000) -> DataFrame:
    """(key, n_words, hit_from, hit_to, items): maximal runs of hit words and the items that occur.

    One row per document row, whatever the number of blocks. A null or empty text has no words; items without words
    match nothing; an item without id hits words but is not listed; repeated items
    and repeated documents behave like single ones; an empty table of items hits nothing.
    """
    rows = keyed_text(docs, key, text)
    context = docs.sparkSession.sparkContext
    found = []
    n_blocks, blocks = _blocks(items, item_key, item_text, block_words)
    if n_blocks > 1:  # keys may repeat or be null: every row gets a number of its own, part and row, that the blocks share
        numbered = F.struct("key", F.monotonically_increasing_id().alias("row"))
        rows = stored(rows.select(numbered.alias("key"), "text"), "numbered", compression="zstd")
    for block in blocks:
        phrases = phrases_of(block, window)
        index = build_index(rows, context.broadcast(phrases.vocabulary))
        counts = context.broadcast(term_counts(index, len(phrases.vocabulary)))
        kind = rows.schema["key"].dataType.simpleString()
        schema = f"key {kind}, n_words long, hit_from array<long>, hit_to array<long>, items array<string>"
        part = index.mapInArrow(_search(context.broadcast(phrases), counts), schema)
        found.append(part)
    if len(found) == 1:
        return found[0].withColumnRenamed("key", key)
    every = found[0]
    for part in found[1:]:
        every = every.union(part)
    # blocks of items: merge the runs of a document row
    merged = every.groupBy("key.row").agg(
        F.first("key.key").alias("key"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("hit_from", "hit_to")))).alias("runs"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    empty = F.array().cast("array<struct<hit_from:bigint,hit_to:bigint>>")

    def join_runs(done, run):
        last = F.element_at(done, -1)
        longer = F.struct(last["hit_from"].alias("hit_from"), F.greatest(last["hit_to"], run["hit_to"]).alias("hit_to"))
        touches = (F.size(done) > 0) & (run["hit_from"] <= F.try_element_at(done, F.lit(-1))["hit_to"])
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(run)))

    runs = F.aggregate("runs", empty, join_runs)
    merged = merged.withColumn("runs", runs)
    return merged.select(F.col("key").alias(key), "n_words", F.col("runs.hit_from").alias("hit_from"), F.col("runs.hit_to").alias("hit_to"), F.array_sort("items").alias("items"))


def find_near(docs: DataFrame, terms: Sequence[str], within: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, position): places of the rarest of ``terms`` with all others at most ``within`` words away."""
    rows = keyed_text(docs, key, text)
    context = docs.sparkSession.sparkContext
    wanted = sorted({w for t in terms for w in words_of(t.encode())})
    vocabulary = {w: i for i, w in enumerate(wanted)}
    index = build_index(rows, context.broadcast(vocabulary))
    counts = term_counts(index, len(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, words, starts, segment in _segments(batch, len(vocabulary)):
                if not vocabulary:
                    continue
                at = []
                for d in range(len(words)):  # a document at a time: distance does not cross documents
                    own = segment.positions
                    keep = (own >= starts[d]) & (own < starts[d + 1])
                    terms_here = np.repeat(np.arange(len(vocabulary)), np.diff(segment.first))[keep]
                    one = Segment(*np.unique(terms_here, return_counts=True), own[keep], len(vocabulary))
                    at.append(one.near(range(len(vocabulary)), counts, within) - starts[d])
                owner = np.repeat(np.arange(len(words)), [len(a) for a in at])
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner)), pa.array(np.concatenate(at), pa.int64())], ["key", "position"])

    kind = rows.schema["key"].dataType.simpleString()
    return index.mapInArrow(run, f"key {kind}, position long").withColumnRenamed("key", key)


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                  item_text: str = "text", share: int = 20) -> DataFrame:
    """(key, n_words, n_hit, items, contaminated): contaminated if a word is hit and ``share`` * n_hit >= n_words."""
    found = find_phrases(docs, items, key, text, item_key, item_text)
    lengths = F.zip_with("hit_to", "hit_from", lambda b, a: b - a)
    hit = F.aggregate(lengths, F.lit(0).cast("long"), lambda s, x: s + x)
    found = found.withColumn("n_hit", hit)
    return found.select(key, "n_words", "n_hit", "items", ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
