"""Near copies by an LSH forest over MinHash signatures.

A document is its set of distinct word n-grams, and a signature holds 72 minimum
hashes of the set. The forest reads the signature in 24 orders: order t begins at
value 3t and goes round. Documents that share the first three values of an order
form a region of that tree; two sets of similarity 0.8 share one with probability
0.51, so all 24 trees miss them with probability 3e-8. Within a region sets are
compared by their whole signatures (one byte a value), longest common prefixes
first. A crowded region is left for the deeper ones inside it (6, 9, then 12 shared
values), so depth adapts to how many sets are alike there; what is still crowded
at the end shares 12 values and is taken as one neighbourhood without comparing.

Sets whose signatures may belong to linked sets, directly or in a chain, form a
neighbourhood. The texts of a neighbourhood meet once, and there every link is
confirmed on the full sets: 100 * intersection >= percent * union. A neighbourhood
too large for a task is cut into tiles by its number of n-grams; sets that are
connected already are not compared again, within tiles and across them.

Distribution: equal sets are one vertex, named once a task. A tree row is a region's
hash, a vertex and 72 bytes; it is shuffled by region, no region of more than
``crowd`` sets reaches a task, and tasks return stars, never all pairs. N-grams are
compared as 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgauge.llm.common import by_slices, components, keyed_text, local_roots, mixed, release_memory, slices, stored, text_bytes
from sparkgauge.llm.ngram_join import shingle_sets, stars, vertex_of

TREES, STEP = 24, 3  # sorted orders, and values by which a region gets deeper
SIZE = TREES * STEP
DEEPEST = 4  # steps
SLICE_BYTES = 1 << 19
ROWS_AT_ONCE = 20_000  # tree rows that a task compares at a time
MARKS = 1 << 26  # bits that mark the documents whose texts are read again

_DRAWN = mixed(np.arange(1, 2 * SIZE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FLIP, _FACTOR = _DRAWN[:SIZE], _DRAWN[SIZE:] | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, SIZE) minimum hashes of sets that are not empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((SIZE, len(sets)), np.uint64)
    room = np.empty_like(flat)
    for i in range(SIZE):
        np.bitwise_xor(flat, _FLIP[i], out=room)
        np.multiply(room, _FACTOR[i], out=room)
        out[i] = np.minimum.reduceat(room, starts)
    return out.T


def regions_of(values: np.ndarray) -> np.ndarray:
    """(sets, TREES) hash of the first STEP values of each order and of the tree."""
    own = values.reshape(-1, TREES, STEP)
    keys = np.arange(1, TREES + 1, dtype=np.uint64) * _FACTOR[0]
    for k in range(STEP):
        keys = mixed(keys + own[:, :, k] * _FACTOR[k + 1])
    return keys


def alike_values(percent: int) -> int:
    """Equal values out of SIZE that a linked pair falls short of with a chance below one in 10**8: six deviations."""
    p = percent / 100
    return max(0, math.floor(SIZE * p - 6 * math.sqrt(SIZE * p * (1 - p))))


def _read(n: int):
    """One row per document: size and digest of the set; its signature unless the task has met the set before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            sets = [np.unique(g) for g in shingle_sets(*text_bytes(part.column(1)), n)]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            numbers = [vertex_of(d) if d else None for d in digests]
            new = []
            for i, number in enumerate(numbers):
                if number is not None and number not in seen:
                    seen.add(number)
                    new.append(i)
            sketch: list = [None] * len(sets)
            regions: list = [None] * len(sets)
            if new:
                values = signatures([sets[i] for i in new])
                small = (mixed(values) & np.uint64(255)).astype(np.uint8)
                for i, one, keys in zip(new, small, regions_of(values).view(np.int64)):
                    sketch[i], regions[i] = one.tobytes(), keys
            columns = [
                part.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(digests, pa.binary()), pa.array(numbers, pa.int64()),
                pa.array(sketch, pa.binary()), pa.array(regions, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", "digest", "number", "sketch", "regions"])

        yield from by_slices(work, SLICE_BYTES)(batches)

    return run


def alike(region: np.ndarray, number: np.ndarray, n: np.ndarray, sketch: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (vertex, root) that connect the vertices of a region whose sizes and signatures may be those of linked sets.

    Rows are sorted by region. Every row is held against the k-th one after it in its
    region, unless the two are connected already.
    """
    need = alike_values(percent)
    vertices, code = np.unique(number, return_inverse=True)
    label = np.arange(len(vertices))
    at, k = np.arange(len(region)), 1
    while True:
        at = at[at + k < len(region)]
        at = at[region[at + k] == region[at]]
        if not len(at):
            away = label != np.arange(len(label))
            return vertices[away], vertices[label[away]]
        a, b = n[at], n[at + k]
        fit = (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (label[code[at]] != label[code[at + k]])
        fit = at[fit]
        fit = fit[(sketch[fit] == sketch[fit + k]).sum(1) >= need]
        if len(fit):
            joined, roots = local_roots(label[code[fit]], label[code[fit + k]])
            moved = np.arange(len(vertices))
            moved[joined] = roots
            label = moved[label]
        k += 1


def _scan(percent: int):
    """Compares the sets of each region of a partition that is sorted by region; returns stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def compare(last: bool) -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            region, number, n = (whole.column(c).to_numpy() for c in ("region", "number", "n"))
            cut = len(region) if last else int(np.searchsorted(region, region[-1]))  # the last region may go on
            raw, _ = text_bytes(whole.column("sketch").chunk(0))
            v, u = alike(region[:cut], number[:cut], n[:cut], raw.reshape(-1, SIZE)[:cut], percent)
            held[:] = whole.slice(cut).to_batches()
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(u, pa.int64())], ["v", "u"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch.select(["region", "number", "n", "sketch"]))
            if sum(b.num_rows for b in held) >= ROWS_AT_ONCE:
                yield compare(False)
        if held:
            yield compare(True)
        release_memory()

    return run


def neighbours(sets: DataFrame, percent: int, crowd: int) -> DataFrame:
    """(v, u): stars of sets that the forest finds alike; every region is worked at the depth its crowd asks for."""
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sets.filter("sketch is not null").select("number", "n", "sketch", F.posexplode("regions").alias("tree", "region"))
    found = []
    for step in range(1, DEEPEST + 1):
        counts = rows.groupBy(F.col("region").alias("busy")).agg(F.count("*").alias("members"))
        busy = stored(counts.filter(F.col("members") > crowd).select("busy"), "forest-crowds")
        crowded = bool(busy.limit(1).count())
        calm = rows.join(busy, F.col("region") == F.col("busy"), "left_anti") if crowded else rows
        dealt = calm.repartition(parts, "region").sortWithinPartitions("region", "number")
        found.append(dealt.mapInArrow(_scan(percent), "v long, u long"))
        if not crowded:
            break
        rows = rows.join(busy, F.col("region") == F.col("busy"), "left_semi")
        if step == DEEPEST:
            first = rows.groupBy(F.col("region").alias("busy")).agg(F.min("number").alias("u"))
            found.append(rows.join(first, F.col("region") == F.col("busy")).filter("number <> u").select(F.col("number").alias("v"), "u"))
        else:
            place = F.pmod(F.col("tree") + step, F.lit(TREES)) * STEP + 1
            deeper = F.substr("sketch", place, F.lit(STEP))
            rows = stored(rows.withColumn("region", F.xxhash64("region", deeper)), "forest-rows")
    out = found[0]
    for one in found[1:]:
        out = out.union(one)
    return out


def marked(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Those ``rows`` whose key may be among ``keys``: all that are, and a few more.

    Keys are marked in a bitmap of MARKS bits by hash (8 MB at most, whatever their
    number), so that other texts are not shuffled. A full bitmap lets all rows pass.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKS)) + 1
    own = bit(F.col(column).cast("long"))
    bits = keys.groupBy(F.bitmap_bucket_number(own).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(own)).alias("bits"))
    at = bit(F.col("key"))
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substr("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("slice", F.bitmap_bucket_number(at)).join(F.broadcast(bits), F.col("slice") == F.col("bucket"))
    return met.filter(F.call_function("shiftright", byte, F.pmod(place, F.lit(8)).cast("int")).bitwiseAND(1) == 1).select(*rows.columns)


def tiles_of(members: DataFrame, tile: int) -> DataFrame:
    """``members`` (vertex, block, n) with the number of tiles of their block, of about ``tile`` n-grams each, and their own by hash."""
    sizes = members.groupBy(F.col("block").alias("own")).agg(F.sum("n").alias("weight"), F.count("*").alias("sets"))
    members = members.join(sizes, F.col("block") == F.col("own"))
    count = F.least(F.ceil(F.col("weight") / F.lit(tile)), F.col("sets")).cast("int")
    return members.select("vertex", "block", "n", count.alias("tiles"), F.pmod(F.xxhash64("vertex"), count).cast("int").alias("tile"))


def confirmed(sets: list[np.ndarray], side: np.ndarray, percent: int) -> np.ndarray:
    """Labels of sets: equal where links on the full sets connect them.

    Sets of side 1 are compared with those of side 0 only, sets of side 0 alone with each other.
    """
    sizes = np.array([len(s) for s in sets])
    _, flat, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    posting = owner[np.argsort(flat, kind="stable")]  # sets that hold an n-gram, n-gram after n-gram
    starts = np.cumsum(often) - often
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    label = np.arange(len(sets))
    probes = np.flatnonzero(side == side.max())
    target = side == 0
    for i in probes:
        wanted = target & (label != label[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        if not wanted.any():
            continue
        codes = flat[bounds[i] : bounds[i + 1]]
        counts = often[codes]
        ends = np.cumsum(counts)
        holders = posting[np.repeat(starts[codes] - ends + counts, counts) + np.arange(ends[-1])]
        shared = np.bincount(holders, minlength=len(sets))
        linked = wanted & (100 * shared >= percent * (sizes + sizes[i] - shared))
        if linked.any():
            label[np.isin(label, label[linked])] = label[i]
    return label


def _confirm(n: int, percent: int):
    """Links of one group of sets, or between its two sides, as stars."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sets, sides = [], [], []
        for batch in batches:
            part = batch.select(["vertex", "text", "side"])
            keys.append(part.column(0).to_numpy())
            sides.append(part.column(2).to_numpy())
            for piece in slices(part, limit=SLICE_BYTES):
                sets += [np.unique(g) for g in shingle_sets(*text_bytes(piece.column(1)), n)]
        v, u = stars(np.concatenate(keys), confirmed(sets, np.concatenate(sides), percent))
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(u, pa.int64())], ["v", "u"])

    return run


def _links(texts: DataFrame, groups: DataFrame, n: int, percent: int) -> DataFrame:
    """(v, u): links of every group (block, a, b) of the rows (vertex, block, a, b, side)."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = texts.join(groups, F.col("key") == F.col("vertex")).select("vertex", "text", "side", "block", "a", "b")
    found = met.repartition(parts, "block", "a", "b").groupBy("block", "a", "b").applyInArrow(_confirm(n, percent), "v long, u long")
    return stored(found, "forest-links")


def linked(texts: DataFrame, members: DataFrame, n: int, percent: int, tile: int) -> DataFrame:
    """(vertex, root): what links among the ``members`` (vertex, block, n) of each neighbourhood connect.

    Sets meet within their tile first. Where a neighbourhood has several tiles, the
    smallest vertex of every component of a tile meets those of other tiles; the largest
    component so far is then left alone, and all other sets meet all tiles. Two sets of
    different components are never both in the largest one, so no link is lost, and a
    neighbourhood of near copies costs its size, not its square.
    """
    zero = F.lit(0)
    dealt = stored(tiles_of(members, tile), "forest-tiles")
    alone = dealt.select("vertex", "block", F.col("tile").alias("a"), zero.alias("b"), zero.alias("side"))
    links = _links(texts, alone, n, percent)
    large = dealt.filter("tiles > 1")
    if not large.limit(1).count():
        return components(links, "v", "u")
    name = lambda found: large.join(
        found.select(F.col("vertex").alias("far"), "root"), F.col("vertex") == F.col("far"), "left"
    ).select(*large.columns, F.coalesce("root", "vertex").alias("root"))
    heads = tiles_of(stored(name(components(links, "v", "u")).filter("vertex = root").select("vertex", "block", "n"), "forest-heads"), tile)
    links = links.union(_links(texts, heads.select("vertex", "block", F.col("tile").alias("a"), zero.alias("b"), zero.alias("side")), n, percent))
    named = stored(name(components(links, "v", "u")), "forest-named")
    counts = stored(named.groupBy("block", "root").agg(F.count("*").alias("size")), "forest-sizes")
    top = counts.groupBy(F.col("block").alias("own")).agg(F.max("size").alias("most"))
    top = counts.join(top, (F.col("block") == F.col("own")) & (F.col("size") == F.col("most"))).groupBy(F.col("block").alias("own")).agg(F.min("root").alias("main"))
    rest = named.join(top, F.col("block") == F.col("own")).filter("root <> main").select("vertex", "block", "n")
    rest = stored(tiles_of(stored(rest, "forest-rest"), tile), "forest-rest-tiles")
    shapes = rest.groupBy(F.col("block").alias("own")).agg(F.max("tiles").alias("others"))
    whole = large.join(shapes, F.col("block") == F.col("own"))
    side0 = whole.select("vertex", "block", F.col("tile").alias("a"), F.explode(F.sequence(zero, F.col("others") - 1)).alias("b"), zero.alias("side"))
    width = large.groupBy(F.col("block").alias("own")).agg(F.max("tiles").alias("others"))
    probes = rest.join(width, F.col("block") == F.col("own"))
    side1 = probes.select("vertex", "block", F.explode(F.sequence(zero, F.col("others") - 1)).alias("a"), F.col("tile").alias("b"), F.lit(1).alias("side"))
    links = links.union(_links(texts, side0.union(side1), n, percent))
    return components(links, "v", "u")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80,
                crowd: int = 256, tile: int = 500_000) -> DataFrame:
    """(key, n_shingles, component_id, kept): the smallest key that links reach, itself included; it is kept.

    Null and empty texts, and texts without words, have no n-grams and are linked with
    nothing; a text of fewer words than ``n`` is one n-gram. Equal sets are linked
    whatever their texts. The key is an integer; rows with a null key are their own
    component (null) and kept; repeated keys count as one document with several sets.
    Other columns are neither read nor returned. An empty table gives an empty result.
    Every link returned holds on the full sets; the forest may miss a pair at the
    threshold itself with the chance stated above, less where a chain of others
    connects the two.
    """
    rows = keyed_text(docs, key, text).withColumn("key", F.col("key").cast("long"))
    shape = "key long, n long, digest binary, number long, sketch binary, regions array<long>"
    sets = stored(rows.mapInArrow(_read(n), shape), "forest-sets")
    known = sets.filter("digest is not null and key is not null")
    vertices = known.groupBy("digest").agg(F.min("key").alias("head"), F.min("number").alias("number"), F.min("n").alias("n"))
    vertices = stored(vertices, "forest-vertices")
    blocks = components(neighbours(sets, percent, crowd), "v", "u")
    blocks = stored(blocks.union(blocks.select("root", "root")).distinct(), "forest-blocks")
    members = vertices.join(blocks, F.col("number") == F.col("vertex")).select(F.col("head").alias("vertex"), F.col("root").alias("block"), "n")
    members = stored(members, "forest-members")
    texts = marked(rows.filter("key is not null"), members, "vertex")
    found = linked(texts, members, n, percent, tile).select(F.col("vertex").alias("far"), "root")
    names = vertices.join(found, F.col("head") == F.col("far"), "left")
    names = stored(names.select(F.col("digest").alias("own"), F.coalesce("root", "head").alias("component_id")), "forest-names")
    # rows of one set may be a third of all: a join on small rows, which adaptive execution can split
    out = sets.select("key", "n", "digest").join(names, F.col("digest") == F.col("own"), "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key"))
    kept = F.coalesce(F.col("key") == component, F.lit(True))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))
