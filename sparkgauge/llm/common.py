"""Helpers the operators of this folder share: reading, scratch tables, Arrow batches, word hashes, components."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.session import scratch_path, ship_package

BATCH_BYTES = 1 << 22  # text that a task works on at a time
ARROW_ROWS, ARROW_BYTES = 1_000, 8 << 20  # of a batch on its way to Python; the default is ten thousand rows
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries made and run in here leave no shuffle files; else those stay until the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and its layout is fixed.

    Survives lost executors, because the files belong to no executor. The shuffle files of the write go with its end.
    """
    path = scratch_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(columns: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no column has that name (case does not count)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def prepare(spark: SparkSession) -> None:
    """What the Python side of these operators needs of a session: the package, and small batches."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def keyed_text(df: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """The columns an operator reads, under names of its own, so that other columns cannot clash."""
    prepare(df.sparkSession)
    columns = [F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")]
    return df.select(*columns, *[F.col(f"`{c}`").alias(f"in_{c}") for c in more])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows, without a copy; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if large else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` bytes of text; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    sizes = np.diff(text_bytes(batch.column(batch.schema.get_field_index(column)))[1])
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def by_slices(work: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], limit: int = BATCH_BYTES) -> Callable:
    """A ``mapInArrow`` function that calls ``work`` for bounded runs of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=limit):
                yield from work(part)
        release_memory()

    return run


def release_memory() -> None:
    """Give freed memory back to the system: a Python worker lives on after its task and would keep it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def hash_runs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes; it depends on the bytes alone, not on where they stand."""
    up, down = _POWERS.get(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[raw] * up[: len(raw)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def runs_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside`` bytes; a run never crosses a row's offset."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    starts = np.flatnonzero(inside & (~before | first[:n]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of the edges (a, b), and for each the smallest vertex it reaches."""
    vertices, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(vertices))
    x, y = codes[: len(a)], codes[len(a) :]
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            return vertices, vertices[label]
        label = new


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contracts the edges of a task to stars, a few hundred thousand at a time."""
    held: list[np.ndarray] = []

    def stars(parts: list[np.ndarray]) -> np.ndarray:
        edges = np.concatenate(parts)
        vertices, roots = local_roots(edges[:, 0], edges[:, 1])
        away = vertices != roots
        return np.stack([vertices[away], roots[away]], 1)

    for batch in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1))
        if sum(map(len, held)) > 400_000:
            held = [stars(held)]
            if len(held[0]) > 200_000:  # nothing much left to contract: pass it on
                yield pa.RecordBatch.from_arrays([pa.array(held[0][:, 0]), pa.array(held[0][:, 1])], ["v", "u"])
                held = []
    if held:
        edges = stars(held)
        yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["v", "u"])


def components(edges: DataFrame, v: str, u: str) -> DataFrame:
    """(vertex, root) for every vertex with an edge to another; the root is the smallest vertex reachable.

    Edges are first contracted within each task, then by rounds of large-star and
    small-star (about log of the number of vertices). A round is two map-side
    combined aggregates and two joins on the edges left; each is written to the
    shared folder, and the driver sees one count a round.
    """
    pairs = edges.select(F.col(v).cast("long").alias("v"), F.col(u).cast("long").alias("u"))
    pairs = pairs.filter("v <> u").mapInArrow(_forest, "v long, u long")
    pairs = stored(pairs.distinct(), "edges")
    while True:
        # large star: every larger neighbour moves to the smallest one
        both = pairs.union(pairs.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = stored(both.groupBy("v").agg(F.min("u").alias("m")), "least")
        least = least.select(F.col("v").alias("k"), F.least("v", "m").alias("m"))
        large = both.filter("u > v").join(least, F.col("v") == F.col("k")).select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = stored(large.filter("v <> u").distinct(), "large")
        # small star: every smaller neighbour and the vertex itself move to the smallest one
        least = stored(large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")), "least")
        least = least.select(F.col("v").alias("k"), "m", "n")
        small = large.join(least.filter("n > 1"), F.col("v") == F.col("k")).select(F.col("u").alias("v"), F.col("m").alias("u"))
        small = small.union(least.select(F.col("k").alias("v"), F.col("m").alias("u"))).filter("v <> u").distinct()
        new = stored(small, "edges")
        # done when every vertex has one parent that is itself no child
        many = least.filter("n > 1").limit(1).count()
        if not many and not new.join(new.select(F.col("v").alias("p")), F.col("u") == F.col("p"), "left_semi").limit(1).count():
            return new.select(F.col("v").alias("vertex"), F.col("u").alias("root"))
        pairs = new


