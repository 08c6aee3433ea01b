"""Exact nearest vectors by cosine, with bounds that skip most of the other side.

Scores are (cosine + 1) / 2. On the unit sphere a score falls with the distance, and
distances obey the triangle inequality. The right side is laid out on a fixed grid: a
vector belongs to its nearest pivot (64 vectors drawn by hash) and to a ring of equal
distance around it. A cell knows its least and largest distance to the pivot, so a left
vector's own distance to the pivot bounds its score with everything in the cell.

1. Every left vector meets its nearest cells, enough of them to hold ``k`` vectors. Its
   k-th best score there is a threshold.
2. It then meets only those other cells whose bound reaches the threshold.

A cell is cut by hash of the id into shards of bounded size, and a shard and the left
vectors that meet it are one group: pairs exist only as strips of a matrix in a task,
which returns ``k`` rows a left vector. The driver holds the pivots and one row per cell
(64 x 40 at most). Where vectors have no structure no cell can be skipped; the result is
exact all the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgauge.session import scratch_path, ship_package

PIVOTS = 64
RING = 0.05  # width of a ring; distances on the unit sphere are at most 2
SHARD_ROWS = 8192  # right rows of one group, about
PACK_ROWS = 256  # left rows that a shard meets at a time where all pairs are asked for
STRIP = 512  # rows of either side that are multiplied at a time
SLACK = 1e-6  # rounding of distances
CLOSE = 1e-12  # rounding of a score by another order of summing


def unit_rows(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows scaled to length 1."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 1)
    return matrix / np.sqrt((matrix * matrix).sum(1, keepdims=True))


def _distances(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (units @ pivots.T), 0.0))


def row_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of matching rows; the sum of a row depends on nothing but the row."""
    return ((a * b).sum(1) + 1.0) / 2.0


def _usable(df: DataFrame) -> DataFrame:
    """(id, vector) without null, empty and zero vectors, and those with null or non-finite components."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    return df.select("id", F.col("vector").cast("array<double>").alias("vector")).filter(finite & some)


class Grid:
    """The pivots, and the cells of the right side: pivot, ring, rows, least and largest distance."""

    def __init__(self, right: DataFrame):
        near = right.orderBy(F.xxhash64(F.col("id").cast("string")), F.col("id"), F.col("vector")).limit(PIVOTS).select("vector")
        rows = [r[0] for r in near.collect()]
        self.width = len(rows[0]) if rows else 0
        self.pivots = unit_rows(pa.array([r for r in rows if len(r) == self.width], pa.list_(pa.float64())))
        self.cells = np.zeros((0, 5))
        if rows:
            found = self.place(right).groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("gap").alias("low"), F.max("gap").alias("high"))
            self.cells = np.array(sorted(tuple(r) for r in found.collect()), np.float64).reshape(-1, 5)

    def place(self, df: DataFrame) -> DataFrame:
        """``df`` with pivot, ring and distance to the pivot."""
        pivots = self.pivots

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                far = _distances(unit_rows(batch.column("vector")), pivots)
                pivot = far.argmin(1)
                gap = far[np.arange(len(far)), pivot]
                more = [pa.array(pivot.astype(np.int32)), pa.array((gap / RING).astype(np.int32)), pa.array(gap)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], ["id", "vector", "pivot", "ring", "gap"])

        kind = df.schema["id"].dataType.simpleString()
        return df.filter(F.size("vector") == self.width).mapInArrow(run, f"id {kind}, vector array<double>, pivot int, ring int, gap double")

    def bounds(self, units: np.ndarray) -> np.ndarray:
        """(left rows, cells) the least distance possible."""
        own = _distances(units, self.pivots)[:, self.cells[:, 0].astype(int)]
        return np.maximum(np.maximum(own - self.cells[:, 4], self.cells[:, 3] - own) - SLACK, 0.0)

    def first(self, bounds: np.ndarray, k: int) -> np.ndarray:
        """(left rows, cells) the nearest cells that together hold ``k`` rows."""
        order = np.argsort(bounds, axis=1, kind="stable")
        held = np.cumsum(self.cells[:, 2][order], axis=1)
        early = np.concatenate([np.ones((len(order), 1), bool), held[:, :-1] < k], axis=1)
        out = np.zeros(bounds.shape, bool)
        np.put_along_axis(out, order, early, 1)
        return out


def visits(left: DataFrame, grid: Grid, k: int, threshold: bool) -> DataFrame:
    """(id, vector, pivot, ring): the cells a left row has to meet, the first ones or all others.

    With ``threshold`` the left rows carry the k-th best score so far, null where there are fewer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, STRIP) for i in range(0, batch.num_rows, STRIP)):
                bounds = grid.bounds(unit_rows(part.column("vector")))
                wanted = grid.first(bounds, k)
                if threshold:
                    least = part.column("threshold").to_numpy(zero_copy_only=False).astype(np.float64)
                    least = np.where(np.isnan(least), -1.0, least)
                    wanted = ~wanted & (1.0 - bounds**2 / 4.0 >= least[:, None] - CLOSE)
                row, cell = np.nonzero(wanted)
                places = [pa.array(grid.cells[cell, i].astype(np.int32)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(row)) for c in ("id", "vector")), *places], ["id", "vector", "pivot", "ring"])

    kind = left.schema["id"].dataType.simpleString()
    return left.filter(F.size("vector") == grid.width).mapInArrow(run, f"id {kind}, vector array<double>, pivot int, ring int")


def _best(left: np.ndarray, right: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left row, right row, score) of the ``k`` best right rows; ties go to the earlier right row."""
    rows, columns, scores = [], [], []
    for a in range(0, len(left), STRIP):
        some = left[a : a + STRIP]
        own_row = own_column = np.zeros(0, np.int64)
        own_score = np.zeros(0)
        least = np.full(len(some), -1.0)  # k-th best so far
        for b in range(0, len(right), STRIP):
            rough = (some @ right[b : b + STRIP].T + 1.0) / 2.0
            if rough.shape[1] > k:
                least = np.maximum(least, np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k] - CLOSE)
            i, j = np.nonzero(rough >= (least - CLOSE)[:, None])
            exact = np.concatenate([row_scores(some[i[s : s + 65536]], right[b + j[s : s + 65536]]) for s in range(0, len(i), 65536)] or [own_score[:0]])
            own_row, own_column, own_score = np.concatenate([own_row, i]), np.concatenate([own_column, b + j]), np.concatenate([own_score, exact])
            order = np.lexsort((own_column, -own_score, own_row))
            own_row, own_column, own_score = own_row[order], own_column[order], own_score[order]
            place = np.arange(len(own_row)) - np.searchsorted(own_row, own_row)
            kept = place < k
            own_row, own_column, own_score, place = own_row[kept], own_column[kept], own_score[kept], place[kept]
            full = place == k - 1
            least[own_row[full]] = np.maximum(least[own_row[full]], own_score[full])
        rows.append(a + own_row)
        columns.append(own_column)
        scores.append(own_score)
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in (rows, columns, scores))


def _meet(visiting: DataFrame, placed: DataFrame, grid: Grid, k: int) -> DataFrame:
    """(left_id, right_id, score): the ``k`` best of every shard for the left rows that visit its cell."""
    shards = {(int(c[0]), int(c[1])): -(-int(c[2]) // SHARD_ROWS) for c in grid.cells}
    many = {cell: n for cell, n in shards.items() if n > 1}
    count = F.lit(1)
    if many:
        listed = F.create_map(*[F.lit(x) for (p, r), n in many.items() for x in (p * 1000 + r, n)])
        count = F.coalesce(F.element_at(listed, F.col("pivot") * 1000 + F.col("ring")), F.lit(1))
    shard = F.pmod(F.xxhash64(F.col("id").cast("string"), "vector"), count).cast("int")
    right = placed.select("id", "vector", "pivot", "ring", shard.alias("shard"))
    left = visiting.withColumn("shard", F.explode(F.sequence(F.lit(0), count - 1)))
    kinds = [d.schema["id"].dataType.simpleString() for d in (left, right)]

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows and b.num_rows:
            b = b.take(pa.compute.sort_indices(b, [("id", "ascending")], null_placement="at_end"))
            i, j, score = _best(unit_rows(a["vector"]), unit_rows(b["vector"]), k)
            columns = [a["id"].take(pa.array(i, pa.int64())), b["id"].take(pa.array(j, pa.int64())), pa.array(score, pa.float64())]
        else:
            columns = [a["id"].slice(0, 0), b["id"].slice(0, 0), pa.array([], pa.float64())]
        return pa.Table.from_arrays(columns, ["left_id", "right_id", "score"])

    keys = ("pivot", "ring", "shard")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(pair, f"left_id {kinds[0]}, right_id {kinds[1]}, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("left_id").orderBy(F.col("score").desc(), F.col("right_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(left: DataFrame, right: DataFrame, k: int = 1) -> DataFrame:
    """(left_id, right_id, score, rank): the ``k`` best right rows of every left row, ties to the lower right id.

    Both sides are (id, vector) with ids of any type that sorts; left ids are unique. Null,
    empty and zero vectors, vectors with null or non-finite components and those of another
    length than the right side's have no score and are in no row.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    spark = right.sparkSession
    ship_package(spark)
    left, right = _usable(left), _usable(right)
    grid = Grid(right)
    if not len(grid.cells):
        kinds = [d.schema["id"].dataType.simpleString() for d in (left, right)]
        return spark.createDataFrame([], f"left_id {kinds[0]}, right_id {kinds[1]}, score double, rank int")
    placed = grid.place(right)
    path = scratch_path(spark, "nearest")
    _top(_meet(visits(left, grid, k, False), placed, grid, k), k).write.parquet(path)  # k rows a left row
    early = spark.read.parquet(path)
    full = early.filter(F.col("rank") == k).select(F.col("left_id").alias("of"), F.col("score").alias("threshold"))
    bounded = left.join(full, F.col("id").eqNullSafe(F.col("of")), "left").drop("of")
    late = _meet(visits(bounded, grid, k, True), placed, grid, k)
    return _top(early.drop("rank").unionByName(late), k)


def top1(left: DataFrame, right: DataFrame) -> DataFrame:
    """Best right row per left row. A score must exceed 0 to win; ties go to the lowest id."""
    return nearest(left, right, 1).filter("score > 0").drop("rank")


def cosine01(a: Column, b: Column) -> Column:
    """Score of two vector columns of the same row; null where one is null, has length 0 or another length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (length > 0), (dot(a, b) / length + 1.0) / 2.0)


def _every_pair(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of every row of both sides. They meet in groups of PACK_ROWS by SHARD_ROWS rows, about, by an equi-join of their numbers."""
    packs, shards = (max(-(-df.count() // n), 1) for df, n in ((left, PACK_ROWS), (right, SHARD_ROWS)))

    def numbered(df: DataFrame, own: str, n: int, other: str, others: int) -> DataFrame:
        mine = F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int").alias(own)
        return df.select("*", mine, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    packed = numbered(left, "_pack", packs, "_shard", shards).groupBy("_pack", "_shard").agg(F.collect_list(F.struct(*left.columns)).alias("_rows"))
    met = numbered(right, "_shard", shards, "_pack", packs).join(packed, ["_pack", "_shard"])
    return met.select(*right.columns, F.inline("_rows"))


def pair_scores(pairs: DataFrame | None, left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, score) of the given pairs, whose vectors come from (id, vector) tables; of every pair of rows where none are given."""
    own = left.select(F.col("id").alias("left_id"), F.col("vector").alias("left_vector"))
    other = right.select(F.col("id").alias("right_id"), F.col("vector").alias("right_vector"))
    met = _every_pair(own, other) if pairs is None else pairs.select("left_id", "right_id").join(own, "left_id").join(other, "right_id")
    return met.select("left_id", "right_id", cosine01(F.col("left_vector"), F.col("right_vector")).alias("score"))
