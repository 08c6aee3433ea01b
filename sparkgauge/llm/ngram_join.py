"""N-gram Jaccard self-join by prefix trees.

Each document is a set of word n-grams in one global order. Two linked sets differ
in at most D n-grams, so among the first ``3 * D + 3`` n-grams of their union three
neighbours are shared, and those are neighbours in both sets (sets too short for that
share two neighbours or one n-gram, which then are keys as well): documents that meet
on such a triple, directly or in a chain, form a block that holds every link among
its members. (A prefix filter on single n-grams meets far more often by chance: one
shared passage is enough.) Inside a block the sets, most frequent n-gram first, fill
a radix trie; a probe walks it level by level, sharing the overlap of common
beginnings, and leaves a subtree when the n-grams still to come, in it or in the
probe, cannot reach the overlap needed.

Global order: rarity from a fixed-size table of bucket counts over all
documents, then hash. Any common order gives the same links; a good one keeps
n-grams of many documents out of the beginnings.

Distribution: equal sets are one vertex, named once a task. Triples (hash, vertex)
are shuffled by hash; each list links to its first vertex, not all pairs, which
makes the blocks. A
block of more than ``tile`` sets is cut into tiles and each pair of tiles is one
task's work, so no task holds more than two tiles. Tasks return links as stars, at
most one a set, never all pairs.

N-grams are compared as 60-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkgauge.llm.common import (
    by_slices,
    components,
    free_name,
    hash_runs,
    keyed_text,
    mixed,
    runs_of,
    slices,
    stored,
    text_bytes,
)

SKETCH_BITS = 18
SLICE_BYTES = 1 << 19  # a byte of text takes some 60 bytes while its words are hashed
_PARTS = 64  # the count table is added up in so many slices

# White space of the contract, and small letters for A-Z.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MIX = [np.uint64(x | 1) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a run of texts, and for each text the index of its first word."""
    starts, ends = runs_of(~_SPACE[raw], offsets)
    return hash_runs(_LOWER[raw], starts, ends), np.searchsorted(starts, offsets)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each text its n-gram hashes, with repeats; a text of fewer words is one n-gram, without words none."""
    words, first = word_hashes(raw, offsets)
    grams = np.zeros(len(words), np.uint64)
    whole = max(0, len(words) - n + 1)
    for k in range(n):
        step = np.uint64(pow(int(_MIX[0]), n - k, 1 << 64))
        grams[:whole] += words[k : k + whole] * step
    grams = mixed(grams)
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= n:
            yield grams[a : b - n + 1]
        elif b > a:
            short = np.full(1, b - a, np.uint64)
            for w in words[a:b]:
                short = mixed(short * _MIX[1] + w)
            yield short
        else:
            yield grams[:0]


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _count_slices(n: int):
    """Adds up bucket counts of a task and returns them in ``_PARTS`` slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)

        def add(part: pa.RecordBatch) -> list:
            grams = [np.unique(g) for g in shingle_sets(*text_bytes(part.column(0)), n)]
            if grams:
                counts[:] += np.bincount(_bucket(np.concatenate(grams)), minlength=len(counts))
            return []

        for _ in by_slices(add, SLICE_BYTES)(batches):
            pass
        if counts.any():
            parts = np.split(counts, _PARTS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(_PARTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "counts"]
            )

    return run


def _sum_slices(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for blob in batch.column(1).to_pylist():
            one = np.frombuffer(blob, np.int64)
            total = one.copy() if total is None else total + one
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "counts"])


def rarity_table(docs: DataFrame, n: int) -> np.ndarray:
    """Sixteen steps of commonness for each of 2**18 hash buckets (256 KB whatever the input)."""
    counted = docs.select("text").mapInArrow(_count_slices(n), "part int, counts binary")
    summed = counted.groupBy("part").applyInArrow(_sum_slices, "part int, counts binary").toArrow()
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    width = len(counts) // _PARTS
    for part, blob in zip(summed["part"].to_pylist(), summed["counts"].to_pylist()):
        counts[part * width : (part + 1) * width] = np.frombuffer(blob, np.int64)
    usual = max(1.0, float(np.median(counts)))
    return np.clip(np.ceil(4 * np.log2(np.maximum(counts, 1) / usual + 1e-9)) - 1, 0, 15).astype(np.uint8)


def ordered_set(grams: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Distinct n-grams in the global order: rare ones first. The order is in the top four bits."""
    low = grams & np.uint64((1 << 60) - 1)
    return np.unique(low | rarity[_bucket(grams)].astype(np.uint64) << np.uint64(60))


def _summary(n: int, rarity):
    """One row per document: size and digest of the set."""

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes, digests, numbers = [], [], []
        for grams in shingle_sets(*text_bytes(part.column(1)), n):
            s = ordered_set(grams, rarity.value)
            sizes.append(len(s))
            digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            digests.append(digest if len(s) else None)
            numbers.append(vertex_of(digest))
        columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(numbers, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["key", "n", "digest", "number"])

    return by_slices(work, SLICE_BYTES)


LEAST_PERCENT = 67  # below it, a triple need not be shared whatever the size


def most_different(n: int, percent: int) -> int:
    """The most n-grams in which a set of ``n`` can differ from a linked one.

    Among partners whose sizes have the same parity the difference grows with the size,
    so the two largest partners decide.
    """
    m = 100 * n // percent
    return max(n + k - 2 * -(-percent * (n + k) // (100 + percent)) for k in (m, m - 1) if k > 0)


@lru_cache(maxsize=None)
def shared_runs(n: int, percent: int) -> tuple[int, ...]:
    """Lengths of the runs of neighbours that are keys of a set of ``n``.

    D differing n-grams cut the union into at most D + 1 shared runs. Where the union
    has 3D + 3 n-grams or more, its first 3D + 3 hold a run of three. Short unions may
    not reach that: then a run of ceil(shared / (D + 1)) is certain, two or one.
    """
    found = {3} if n > 2 else set()
    if 3 * most_different(n, percent) + 3 > n:  # every union has n n-grams at least
        for m in range(1, 100 * n // percent + 1):
            for shared in range(max(1, -(-percent * (n + m) // (100 + percent))), min(n, m) + 1):
                union, apart = n + m - shared, n + m - 2 * shared
                if apart and union < 3 * apart + 3:
                    found.add(min(3, -(-shared // (apart + 1))))
    return tuple(sorted(found))


def triples(s: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of neighbouring triples at the beginning of an ordered set, and of pairs and single
    n-grams of sets so short that a triple is not certain; none if no other set can be linked."""
    d = most_different(len(s), percent) if len(s) else 0
    if d < 1:
        return s[:0]
    s = s[: 3 * d + 3]
    out = []
    for run in shared_runs(len(s), percent) if len(s) < 3 * d + 3 else (3,):
        keys = s[run - 1 :]
        for k in range(run - 2, -1, -1):
            keys = mixed(s[k : len(s) - run + 1 + k] * _MIX[2 - k] + mixed(keys))
        out.append(mixed(keys) if run == 1 else keys)
    return np.concatenate(out) if out else s[:0]


def vertex_of(digest: bytes) -> int:
    """A set's number: the first eight bytes of its digest."""
    return int.from_bytes(digest[:8], "little", signed=True)


def _keys(n: int, percent: int, rarity):
    """(triple, vertex) rows of the sets that a task has not seen before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found, vertices = [np.zeros(0, np.uint64)], []
            for grams in shingle_sets(*text_bytes(part.column(0)), n):
                s = ordered_set(grams, rarity.value)
                vertex = vertex_of(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                if vertex not in seen:
                    seen.add(vertex)
                    found.append(triples(s, percent))
                    vertices.append(np.full(len(found[-1]), vertex, np.int64))
            if vertices:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(vertices))], ["triple", "vertex"])

        yield from by_slices(work, SLICE_BYTES)(batches)

    return run


class Trie:
    """A radix trie of sorted sets: each node owns a run of n-grams that all sets below it share.

    Nodes lie level by level, so a probe handles a level at once.
    """

    def __init__(self, sets: list[np.ndarray], common: np.ndarray):
        """``sets``: codes in trie order, sorted lexicographically as sequences.

        Only ``common`` codes, those of two sets or more, are kept to be matched.
        """
        self.levels: list[tuple[np.ndarray, ...]] = []
        sizes = np.array([len(s) for s in sets])
        shared = [0] * len(sets)  # with the set before
        for i in range(1, len(sets)):
            m = min(sizes[i], sizes[i - 1])
            differ = np.flatnonzero(sets[i][:m] != sets[i - 1][:m])
            shared[i] = int(differ[0]) if len(differ) else int(m)
        # groups of sets with the same beginning, split level by level
        level = [(-1, 0, len(sets), 0)] if sets else []  # parent, first set, past the last, depth
        while level:
            parents, tokens, starts, ends, first, past, low, high, deep, last = [], [], [0], [], [], [], [], [], [], []
            after, count = [], 0
            for parent, a, b, depth in level:
                at = a
                while at < b:
                    end = at + 1
                    while end < b and shared[end] > depth:
                        end += 1
                    to = min(int(sizes[at]), min(shared[at + 1 : end], default=int(sizes[at])))
                    parents.append(parent)
                    run = sets[at][depth:to]
                    last.append(run[-1])
                    tokens.append(run[common[run]])
                    starts.append(starts[-1] + len(tokens[-1]))
                    done = at
                    while done < end and sizes[done] == to:
                        done += 1
                    ends.append(done - at)  # sets that end here are the first ones
                    first.append(at)
                    past.append(end)
                    low.append(int(sizes[at:end].min()))
                    high.append(int(sizes[at:end].max()))
                    deep.append(to)
                    if done < end:
                        after.append((count, done, end, to))
                    count += 1
                    at = end
            arrays = map(np.array, (starts, ends, first, past, low, high, deep, last))
            self.levels.append((np.array(parents), np.concatenate(tokens), *arrays))
            level = after

    def probe(self, mark: np.ndarray, codes: np.ndarray, percent: int, wanted: np.ndarray) -> list[tuple[int, int]]:
        """(first set, number of sets) whose overlap with the probe reaches the Jaccard index.

        ``codes`` are those of the probe, all set in ``mark``. Subtrees without a
        ``wanted`` set are left out.
        """
        found, size = [], len(codes)
        open_sets = np.concatenate([[0], np.cumsum(wanted)])
        overlap = np.zeros(1, np.int64)  # of the paths that end at the level above
        alive = np.array([True])
        for parents, tokens, starts, ends, first, past, low, high, deep, last in self.levels:
            ok = alive[parents] & (open_sets[past] > open_sets[first])
            ok &= 100 * np.minimum(high, size) >= percent * np.maximum(low, size)
            at = np.flatnonzero(ok)
            if not len(at):
                break
            here = np.zeros(len(parents), np.int64)
            a, b = starts[at], starts[at + 1]
            if 2 * (b - a).sum() < len(tokens):  # few nodes left: touch only theirs
                lengths = b - a
                b = np.cumsum(lengths)
                inside = np.repeat(a - b + lengths, lengths) + np.arange(b[-1])
                a = b - lengths
                sums = np.concatenate([[0], np.cumsum(mark[tokens[inside]])])
            else:
                sums = np.concatenate([[0], np.cumsum(mark[tokens])])
            here[at] = overlap[parents[at]] + sums[b] - sums[a]
            hit = at[ends[at] > 0]
            if len(hit):
                need = -(-percent * (size + low[hit]) // (100 + percent))  # sets that end here are the shortest below
                for h in hit[here[hit] >= need]:
                    found.append((int(first[h]), int(ends[h])))
            # what can still come: n-grams of the probe after the last code of this node, or of the sets below it
            most = here[at] + np.minimum(size - np.searchsorted(codes, last[at], "right"), high[at] - deep[at])
            alive = np.zeros(len(parents), bool)
            alive[at] = most >= -(-percent * (size + low[at]) // (100 + percent))
            overlap = here
        return found


def trie_links(keys: np.ndarray, sets: list[np.ndarray], tile: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (key, root) that connect what links connect, among sets of one or two tiles.

    ``sets`` hold n-grams in the global order; the trie takes them from the last to
    the first, since frequent n-grams are the beginnings that sets share. With two
    tiles only links across them are looked for.
    """
    codes, flat, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    flat = len(codes) - 1 - flat
    bounds = np.cumsum([0, *map(len, sets)])
    coded = [flat[a:b][::-1] for a, b in zip(bounds[:-1], bounds[1:])]
    order = sorted(range(len(sets)), key=lambda i: coded[i].astype(">i8").tobytes())
    two = len(np.unique(tile)) > 1
    in_trie = [i for i in order if not two or tile[i] == tile.max()]
    probes = [i for i in order if not two or tile[i] == tile.min()]
    trie = Trie([coded[i] for i in in_trie], often[::-1] > 1)
    # what is connected already needs no second look: only components count
    label = np.arange(len(sets))
    in_trie = np.array(in_trie)
    mark = np.zeros(len(codes), np.int32)
    for i in probes:
        wanted = label[in_trie] != label[i]
        if not wanted.any():
            continue
        mark[coded[i]] = 1
        for first, count in trie.probe(mark, coded[i], percent, wanted):
            for j in in_trie[first : first + count]:
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
        mark[coded[i]] = 0
    return stars(keys, label)


def _blocks(n: int, percent: int, rarity):
    """Links of one block or pair of tiles; its rows are the texts of at most two tiles."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sets, tiles = [], [], []
        for batch in batches:
            part = batch.select(["vertex", "text", "tile"])
            keys.append(part.column(0).to_numpy())
            tiles.append(part.column(2).to_numpy())
            for piece in slices(part, limit=SLICE_BYTES):
                sets += [ordered_set(g, rarity.value) for g in shingle_sets(*text_bytes(piece.column(1)), n)]
        v, u = trie_links(np.concatenate(keys), sets, np.concatenate(tiles), percent)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(u, pa.int64())], ["v", "u"])

    return run


def stars(keys: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, smallest key of its label) for all but the smallest ones."""
    roots = np.arange(len(keys))
    for value in np.unique(label):
        own = np.flatnonzero(label == value)
        roots[own] = own[keys[own].argmin()]
    away = np.flatnonzero(roots != np.arange(len(keys)))
    return keys[away], keys[roots[away]]


def tiles_of(heads: DataFrame, tile: int) -> DataFrame:
    """(vertex, block, tile, a, b): the (head, root) rows of blocks, dealt to pairs of tiles.

    A block has as many tiles as its size asks for; a vertex goes to a tile by hash and
    to every pair (a, b) that holds it.
    """
    members = stored(heads.select(F.col("head").alias("vertex"), F.col("root").alias("block")), "members")
    sizes = stored(members.groupBy("block").agg(F.count("*").alias("members")), "sizes")
    members = members.join(sizes.withColumnRenamed("block", "_b"), F.col("block") == F.col("_b"))
    count = F.ceil(F.col("members") / F.lit(tile)).cast("int")
    members = members.select("vertex", "block", count.alias("tiles"), F.pmod(F.xxhash64("vertex"), count).cast("int").alias("tile"))
    other = F.sequence(F.lit(0), F.col("tiles") - 1)
    pairs = F.transform(other, lambda x: F.struct(F.least(x, F.col("tile")).alias("a"), F.greatest(x, F.col("tile")).alias("b")))
    return members.select("vertex", "block", "tile", F.explode(pairs).alias("pair")).select("vertex", "block", "tile", "pair.a", "pair.b")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4,
                       percent: int = 85, tile: int = 1_024) -> DataFrame:
    """(key, n_shingles, component_id): the smallest key that links reach, itself included.

    Null and empty texts, and texts without words, have no n-grams and are linked
    with nothing. Equal sets are linked whatever their texts. The key is an integer;
    rows with a null key are their own component (null); repeated keys count as one
    document with several sets. An empty table gives an empty result. ``percent`` is
    LEAST_PERCENT at least: below it the blocks would not hold every link.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be {LEAST_PERCENT} to 100")
    rows = keyed_text(docs, key, text).withColumn("key", F.col("key").cast("long"))
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rarity = spark.sparkContext.broadcast(rarity_table(rows, n))
    slim = stored(rows.mapInArrow(_summary(n, rarity), "key long, n long, digest binary, number long"), "ngram-sets")
    # one vertex for each distinct set, with its smallest key; a map-side combined aggregate over 30 bytes a row
    known = slim.filter("digest is not null and key is not null")
    vertices = stored(known.groupBy(F.col("digest").alias("_d")).agg(F.min("key").alias("head"), F.min("number").alias("number")), "ngram-vertices")
    keys = rows.filter("key is not null").select("text").mapInArrow(_keys(n, percent, rarity), "triple long, vertex long")
    near = Window.partitionBy("triple").orderBy("vertex")
    chain = keys.select("vertex", F.first("vertex").over(near).alias("other")).filter("vertex <> other").distinct()
    blocks = components(chain, "vertex", "other")
    blocks = stored(blocks.union(blocks.select("root", "root")).distinct(), "ngram-blocks")
    heads = vertices.join(blocks, F.col("number") == F.col("vertex")).select("head", "root")
    texts = rows.join(tiles_of(heads, tile), F.col("key") == F.col("vertex")).select("vertex", "text", "tile", "block", "a", "b")
    # blocks differ in work, not in bytes: a fixed number of partitions, so that few are not merged into fewer
    links = texts.repartition(parts, "block", "a", "b").groupBy("block", "a", "b").applyInArrow(_blocks(n, percent, rarity), "v long, u long")
    found = components(links, "v", "u").select(F.col("vertex").alias("_k"), "root")
    names = vertices.join(found, F.col("head") == F.col("_k"), "left")
    names = stored(names.select("_d", F.coalesce("root", "head").alias("component_id")), "ngram-names")
    # rows of one set may be a third of all: a join on small rows, which adaptive execution can split
    out = slim.join(names, F.col("digest") == F.col("_d"), "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key")).alias("component_id"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents whose component has a smaller key.

    A keyless row stays: it is linked with nothing.
    """
    found = jaccard_components(docs, key, text, n, percent)
    own = free_name(docs.columns, "gone")
    gone = found.filter(F.col(f"`{key}`") > F.col("component_id")).select(F.col(f"`{key}`").alias(own)).distinct()
    return docs.join(gone, F.col(f"`{key}`") == F.col(own), "left_anti")
