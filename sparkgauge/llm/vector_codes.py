"""Codes for vectors: every part of a vector becomes the number of its nearest codebook entry.

A task takes a chunk of vectors. Each part of the chunk is sorted along a Hilbert
curve and cut into flat blocks, which store the smallest box around their points
and the sum of them. In a round the distances from a box to the entries bound those
of all its points: entries whose smallest distance is above the least largest one
are off the block's shortlist. A block with one entry left adds its stored sum and
its points are not looked at; the others go through an integer kernel over their
shortlist only.

Distribution: chunks are written once to the shared folder and read by every round.
Nothing is shuffled but one row per part and task; the driver keeps the codebooks
(parts x entries x width integers), which travel with the tasks. All parts of a
vector stay in one chunk, so codes need no regrouping. Sums are exact at any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgauge.llm.common import free_name, prepare, release_memory, stored

SCALE = 4096.0
CHUNK, BLOCK = 16_384, 32  # vectors sorted together, and points of a block
NARROW = 1 << 26  # below it, squared distances of 512 components fit 64 bits
KERNEL = 1 << 21  # numbers that a kernel call works on
LARGEST = (1 << 63) - 1


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along a Hilbert curve of grid cells (rows of axis values below 2**bits)."""
    x = cells.T.astype(np.uint64)
    zero = np.uint64(0)
    for shift in range(bits - 1, 0, -1):
        q = np.uint64(1 << shift)
        low = q - np.uint64(1)
        for axis in x:
            high = (axis & q) != 0
            x[0] ^= np.where(high, low, zero)
            swap = np.where(high, zero, (x[0] ^ axis) & low)
            x[0] ^= swap
            axis ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for shift in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & np.uint64(1 << shift), np.uint64((1 << shift) - 1), zero)
    keys = np.zeros(x.shape[1], np.uint64)
    for shift in range(bits - 1, -1, -1):
        for axis in x:
            keys = keys << np.uint64(1) | ((axis ^ turn) >> np.uint64(shift)) & np.uint64(1)
    return keys


def curve_order(values: np.ndarray) -> np.ndarray:
    """Order of points along the curve; beyond 62 axes only the first ones count."""
    axes = values[:, :62].astype(np.float64)
    if not axes.size:
        return np.arange(len(axes))
    bits = max(1, 62 // axes.shape[1])
    low, high = axes.min(), axes.max()
    if not np.isfinite(high - low) or high <= low:
        return np.arange(len(axes))
    grid = np.floor((axes - low) / (high - low) * ((1 << bits) - 1))
    return np.argsort(hilbert_keys(grid, bits), kind="stable")


def bounds_of(width: int, parts: int) -> list[int]:
    """First component of each part, and the end."""
    return [width * p // parts for p in range(parts + 1)]


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(4096 x) as integers of any size (``object``), or as int64 where all are narrow."""
    if np.abs(vectors).max(initial=0) < NARROW / SCALE:
        return np.floor(vectors * SCALE).astype(np.int64)
    one = lambda x: int(x) * int(SCALE) if abs(x) >= 1e12 else int(np.floor(x * SCALE))
    return np.array([[one(x) for x in row] for row in vectors.tolist()], object).reshape(vectors.shape)


class Blocks(NamedTuple):
    """One part of a chunk in curve order, filled up to whole blocks with its last point."""

    order: np.ndarray  # (n,) row in the chunk
    points: np.ndarray  # (blocks, BLOCK, width)
    low: np.ndarray  # (blocks, width)
    high: np.ndarray
    sums: np.ndarray  # of the real points
    filled: np.ndarray  # (blocks,) real points


def make_blocks(values: np.ndarray) -> Blocks:
    """Blocks of the rows of ``values``."""
    order = curve_order(values)
    values = values[order]
    n, width = values.shape
    count = -(-n // BLOCK)
    extra = count * BLOCK - n
    points = np.concatenate([values, np.repeat(values[-1:], extra, 0)]).reshape(count, BLOCK, width)
    sums = points.sum(1)
    sums[-1] -= values[-1] * extra
    filled = np.full(count, BLOCK)
    filled[-1] -= extra
    return Blocks(order, points, points.min(1), points.max(1), sums, filled)


def shortlists(blocks: Blocks, book: np.ndarray) -> np.ndarray:
    """(blocks, entries) whether some point of the block may have the entry as its nearest."""
    low, high = blocks.low[:, None], blocks.high[:, None]
    below, above = low - book, book - high
    gap = np.maximum(np.maximum(below, above), 0)
    least = (gap * gap).sum(2)
    far = np.maximum(np.abs(below), np.abs(above))
    far = np.maximum(far, np.maximum(book - low, high - book))
    most = (far * far).sum(2)
    return least <= most.min(1)[:, None]


def nearest(blocks: Blocks, book: np.ndarray, distances: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """(blocks, BLOCK) nearest entry, ties to the lower one, and the distances where asked for.

    Entry -1 marks blocks that are settled by their box.
    """
    short = shortlists(blocks, book)
    size = short.sum(1)
    shape = blocks.points.shape[:2]
    found = np.full(shape, -1, np.int64)
    far = np.zeros(shape, blocks.points.dtype) if distances else None
    for k in np.unique(size):
        at = np.flatnonzero(size == k)
        listed = np.nonzero(short[at])[1].reshape(len(at), k)
        if k == 1 and not distances:
            continue
        step = max(1, KERNEL // (BLOCK * int(k) * max(1, book.shape[1])))
        for i in range(0, len(at), step):
            own, entries = at[i : i + step], listed[i : i + step]
            gap = blocks.points[own][:, :, None] - book[entries][:, None]
            square = (gap * gap).sum(3)
            best = square.argmin(2)
            found[own] = np.take_along_axis(entries, best, 1)
            if distances:
                far[own] = np.take_along_axis(square, best[:, :, None], 2)[:, :, 0]
    if not distances:
        only = np.flatnonzero(size == 1)
        found[only] = -1 - np.nonzero(short[only])[1][:, None]
    return found, far


def entry_sums(blocks: Blocks, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and componentwise sum of the points of each entry."""
    found, _ = nearest(blocks, book, False)
    counts = np.zeros(len(book), np.int64)
    sums = np.zeros(book.shape, blocks.points.dtype)
    settled = found[:, 0] < 0
    np.add.at(counts, -1 - found[settled, 0], blocks.filled[settled])
    np.add.at(sums, -1 - found[settled, 0], blocks.sums[settled])
    open_ = ~settled
    real = np.arange(BLOCK) < blocks.filled[open_, None]
    points, labels = blocks.points[open_][real], found[open_][real]
    counts += np.bincount(labels, minlength=len(book))
    for e in np.unique(labels):
        sums[e] += points[labels == e].sum(0)
    return counts, sums


def _chunks(parts: int, width: int):
    """Packs the vectors of a task: one row per chunk, with all its parts' blocks."""

    def pack(ids: pa.Array, labels: pa.Array, vectors: np.ndarray) -> pa.RecordBatch:
        values = whole(vectors)
        narrow = values.dtype != object
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        fields = [b""] * 5
        if narrow:
            edges = bounds_of(width, parts)
            made = [make_blocks(values[:, a:b]) for a, b in zip(edges[:-1], edges[1:])]
            kinds = ("<i4", "<i4", "<i4", "<i4", "<i8")
            columns = zip(*[(b.order, b.points, b.low, b.high, b.sums) for b in made])
            fields = [b"".join(x.astype(k).tobytes() for x in c) for c, k in zip(columns, kinds)]
        else:
            fields[1] = vectors.astype("<f8").tobytes()
        arrays = [one(ids), one(labels), pa.array([narrow]), *[pa.array([f], pa.binary()) for f in fields]]
        return pa.RecordBatch.from_arrays(arrays, ["ids", "labels", "narrow", "row_order", "points", "low", "high", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush() -> pa.RecordBatch:
            whole_batch = pa.Table.from_batches(held).combine_chunks()
            ids, vec, labels = (whole_batch.column(c).chunk(0) for c in ("key", "vec", "label"))
            return pack(ids, labels, vec.flatten().to_numpy(zero_copy_only=False).reshape(-1, width))

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, CHUNK - rows)
                batch = batch.slice(part.num_rows)
                held.append(part)
                rows += part.num_rows
                if rows == CHUNK:
                    yield flush()
                    held, rows = [], 0
        if rows:
            yield flush()
        release_memory()

    return run


def unpack(row: dict, parts: int, width: int, as_objects: bool) -> list[Blocks]:
    """The blocks of a stored chunk; with integers of any size where it or the codebooks need them."""
    edges = bounds_of(width, parts)
    if not row["narrow"]:
        values = whole(np.frombuffer(row["points"], "<f8").reshape(-1, width)).astype(object)
        return [make_blocks(values[:, a:b]) for a, b in zip(edges[:-1], edges[1:])]
    n = len(row["row_order"]) // 4 // parts
    count = -(-n // BLOCK)
    filled = np.full(count, BLOCK)
    filled[-1] = n - (count - 1) * BLOCK
    order = np.frombuffer(row["row_order"], "<i4").reshape(parts, n)
    flat = [np.frombuffer(row[f], k) for f, k in (("points", "<i4"), ("low", "<i4"), ("high", "<i4"), ("sums", "<i8"))]
    out = []
    for p, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        w = b - a
        points = flat[0][count * BLOCK * a : count * BLOCK * b].reshape(count, BLOCK, w)
        low, high, sums = (f[count * a : count * b].reshape(count, w) for f in flat[1:])
        kind = object if as_objects else np.int64
        out.append(Blocks(order[p], *(x.astype(kind) for x in (points, low, high, sums)), filled))
    return out


def _books(books: list[list[list[int]]]) -> tuple[list[np.ndarray], bool]:
    """Codebooks as arrays, and whether they need integers of any size."""
    large = any(abs(v) >= NARROW for book in books for entry in book for v in entry)
    return [np.array(book, object if large else np.int64).reshape(len(book), -1) for book in books], large


def _round(books: list, parts: int, width: int):
    """Counts and sums of a task, one row per part; sums as decimal text, since they may pass 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, large = _books(books)
        totals: list = [None] * parts
        for batch in batches:
            for row in batch.to_pylist():
                for p, blocks in enumerate(unpack(row, parts, width, large)):
                    counts, sums = entry_sums(blocks, arrays[p].astype(blocks.points.dtype))
                    sums = sums.astype(object)
                    totals[p] = (counts, sums) if totals[p] is None else (totals[p][0] + counts, totals[p][1] + sums)
        found = [(p, t[0].tolist(), ",".join(map(str, t[1].ravel()))) for p, t in enumerate(totals) if t]
        if found:
            columns = [pa.array(c, k) for c, k in zip(zip(*found), (pa.int32(), pa.list_(pa.int64()), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "counts", "sums"])
        release_memory()

    return run


def _add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the rows of one part, or of one share of them."""
    counts = sums = None
    for batch in batches:
        for row in batch.select(["counts", "sums"]).to_pylist():
            own = np.array([int(x) for x in row["sums"].split(",")] if row["sums"] else [], object)
            own_counts = np.array(row["counts"], object)
            counts, sums = (own_counts, own) if counts is None else (counts + own_counts, sums + own)
    columns = [pa.array([key[0].as_py()], pa.int32()), pa.array([[int(c) for c in counts]], pa.list_(pa.int64())), pa.array([",".join(map(str, sums))])]
    yield pa.RecordBatch.from_arrays(columns, ["part", "counts", "sums"])


def _codes(books: list, parts: int, width: int):
    """One row per vector: key, label, code and error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, large = _books(books)
        for batch in batches:
            ids, labels = batch.column("ids"), batch.column("labels")
            fields = batch.drop_columns(["ids", "labels"]).to_pylist()
            for i, row in enumerate(fields):
                own = [ids.slice(i, 1).flatten(), labels.slice(i, 1).flatten()]
                n = len(own[0])
                code, error = np.zeros((n, parts), np.uint8), np.zeros(n, object)
                for p, blocks in enumerate(unpack(row, parts, width, large)):
                    found, far = nearest(blocks, arrays[p].astype(blocks.points.dtype), True)
                    code[blocks.order, p] = found.ravel()[:n]
                    error[blocks.order] += far.ravel()[:n]
                text = code.tobytes().hex()
                codes = [text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)]
                error = np.minimum(error, LARGEST).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*own, pa.array(codes, pa.string()), pa.array(error)], ["key", "label", "code", "error"])
        release_memory()

    return run


class Codes(NamedTuple):
    """Coded vectors and the codebooks: part, entry, component."""

    vectors: DataFrame
    codebooks: list[list[list[int]]]

    def digest(self) -> str:
        """SHA-256 of all components of all entries, comma-joined."""
        flat = ",".join(str(v) for book in self.codebooks for entry in book for v in entry)
        return hashlib.sha256(flat.encode()).hexdigest()


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
             parts: int = 8, entries: int = 16, rounds: int = 6) -> Codes:
    """Codes of all vectors: (key, label, code, error) and the codebooks after ``rounds``.

    Codebooks start as the parts of the ``entries`` smallest keys (null keys last, equal
    keys by their vectors); with fewer vectors they are shorter. ``code`` has two hex
    digits a part, at most 256 entries. Null and empty vectors, those that hold null,
    NaN or infinity, and those of another length than the smallest key's are dropped.
    A length that ``parts`` does not divide gives parts of nearly equal width. Repeated
    rows are coded each. Components beyond 64 bits are worked with integers of any size,
    and an error beyond 2**63 - 1 is shown as that. Other columns are not read. An
    empty table gives an empty result without codebooks.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256")
    spark = df.sparkSession
    prepare(spark)
    kept = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("vec"), F.col(f"`{label}`").alias("label"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = kept.filter((F.size("vec") > 0) & finite)
    first = kept.select("key", "vec").orderBy(F.col("key").asc_nulls_last(), "vec").limit(entries).collect()
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    width = len(first[0]["vec"]) if first else 1
    first = [r["vec"] for r in first if len(r["vec"]) == width]
    edges = bounds_of(width, parts)
    start = whole(np.array(first, np.float64).reshape(-1, width)).tolist()
    books = [[row[a:b] for row in start] for a, b in zip(edges[:-1], edges[1:])] if first else []
    shape = f"ids array<{kinds['key']}>, labels array<{kinds['label']}>, narrow boolean, row_order binary, points binary, low binary, high binary, sums binary"
    result = f"key {kinds['key']}, label {kinds['label']}, code string, error long"
    chunks = kept.filter(F.size("vec") == width).mapInArrow(_chunks(parts, width), shape)
    if first:
        chunks = stored(chunks, "vector-blocks")
    for _ in range(rounds if first else 0):
        found = chunks.mapInArrow(_round(books, parts, width), "part int, counts array<long>, sums string")
        found = found.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(64)))
        added = found.groupBy("part", "share").applyInArrow(_add, "part int, counts array<long>, sums string")
        added = added.groupBy("part").applyInArrow(_add, "part int, counts array<long>, sums string")
        for row in added.collect():  # one row per part
            book = books[row["part"]]
            w = len(book[0])
            sums = [int(x) for x in row["sums"].split(",")] if w else []
            books[row["part"]] = [[s // c for s in sums[e * w : (e + 1) * w]] if c else book[e] for e, c in enumerate(row["counts"])]
    coded = chunks.mapInArrow(_codes(books, parts, width), result)
    return Codes(coded.withColumnsRenamed({"key": key, "label": label}), books)


def with_label_error(vectors: DataFrame, label: str = "label") -> DataFrame:
    """``vectors`` with the error summed over equal labels, null labels together."""
    vectors = stored(vectors, "vector-codes")
    own = free_name(vectors.columns, "of_label")
    total = vectors.groupBy(F.col(f"`{label}`").alias(own)).agg(F.sum(F.col("error").cast("decimal(20,0)")).alias("total"))
    total = total.select(own, F.least("total", F.lit(LARGEST).cast("decimal(30,0)")).cast("long").alias("label_error"))
    return vectors.join(total, F.col(f"`{label}`").eqNullSafe(F.col(own))).drop(own)
