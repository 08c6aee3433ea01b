"""Exact deduplication with two passes of a Bloom filter.

Pass one sets, for each row's hash, a few cells of a filter that knows "seen
once" and "seen again". Pass two tests each row against "seen again": a row that
fails is the only one of its text and passes straight through; the others, the
copies and a few false alarms, are shuffled and settled exactly by their SHA-256.

Cells are merged in slices of a fixed width, so no task holds more than one
slice of many partial filters. The "seen again" filter is broadcast; it has about
``cells_per_row`` bits a row and never more than ``max_bits``. Beyond that the
rate of false alarms rises, more rows are shuffled, and the result is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgauge.llm.common import by_slices, free_name, keyed_text, stored, text_bytes

HASHES = 4
MAX_BITS = 1 << 30
SLICE_BITS = 1 << 20
_SPACES = b" \t\n\x0b\x0c\r"


def _digests(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Key, SHA-256 of the text without ASCII white space, code points of the text."""
    raw, offsets = text_bytes(part.column(1))
    raw = raw.tobytes()
    found = [hashlib.sha256(raw[a:b].translate(None, _SPACES)).digest() for a, b in zip(offsets[:-1], offsets[1:])]
    points = pc.fill_null(pc.utf8_length(part.column(1)), 0).cast(pa.int64())
    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary()), points], ["key", "sha", "points"])


def cells(digests: pa.Array, bits: int) -> np.ndarray:
    """Rows x ``HASHES`` cells of the filter, from the digest's own bytes."""
    flat = np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 4)
    return (flat[:, :HASHES] & np.uint64(bits - 1)).astype(np.int64)


def _seen(bits: int):
    """Cells that a task has seen once and again, as sorted offsets within slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(held: list[np.ndarray]) -> pa.RecordBatch:
            cell, count = np.unique(np.concatenate(held), return_counts=True)
            of = cell // SLICE_BITS
            cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            ends = np.append(cut[1:], len(cell))
            once = [(cell[a:b] % SLICE_BITS).astype("<u4").tobytes() for a, b in zip(cut, ends)]
            again = [np.packbits(count[a:b] > 1).tobytes() for a, b in zip(cut, ends)]
            return pa.RecordBatch.from_arrays([pa.array(of[cut], pa.int32()), pa.array(once, pa.binary()), pa.array(again, pa.binary())], ["slice", "cells", "again"])

        held, size = [], 0
        for batch in batches:
            own = cells(batch.column(0), bits)
            # a row sets a cell once, though two of its hashes may meet there
            own = np.sort(own, axis=1)
            keep = np.ones(own.shape, bool)
            keep[:, 1:] = own[:, 1:] != own[:, :-1]
            held.append(own[keep])
            size += len(held[-1])
            if size > 1 << 22:
                yield emit(held)
                held, size = [], 0
        if held:
            yield emit(held)

    return run


def _merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The "seen again" bits of one slice."""
    once, again = np.zeros(SLICE_BITS, bool), np.zeros(SLICE_BITS, bool)
    for batch in batches:
        for blob, twice in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            at = np.frombuffer(blob, "<u4")
            many = np.unpackbits(np.frombuffer(twice, np.uint8), count=len(at)).astype(bool)
            again[at] |= once[at] | many
            once[at] = True
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(again).tobytes()], pa.binary())], ["slice", "bits"])


def _tested(filter_bits):
    """Adds whether a row's text may be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again = filter_bits.value
        for batch in batches:
            at = cells(batch.column(1), len(again) * 8)
            hit = (again[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit, pa.bool_())], [*batch.schema.names, "maybe"])

    return run


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", cells_per_row: int = 16,
                 max_bits: int = MAX_BITS) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    Texts are equal when they are after removal of ASCII white space; null counts as
    empty, and empty texts are one group. Of equal texts the row with the most code
    points stays, then the one with the smallest key (null keys last), then one of
    the repeated rows: exactly one row of a group is kept. An empty table gives none.
    """
    rows = keyed_text(docs, key, text)
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(by_slices(_digests), f"key {kind}, sha binary, points long")
    found = stored(found, "digests")
    bits = SLICE_BITS
    while bits < min(max_bits, cells_per_row * found.count()):
        bits *= 2
    seen = found.select("sha").mapInArrow(_seen(bits), "slice int, cells binary, again binary")
    merged = seen.groupBy("slice").applyInArrow(_merged, "slice int, bits binary").toArrow()
    again = np.zeros(bits // 8, np.uint8)
    for k, blob in zip(merged["slice"].to_pylist(), merged["bits"].to_pylist()):
        again[k * SLICE_BITS // 8 : (k + 1) * SLICE_BITS // 8] = np.frombuffer(blob, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(again)
    marked = found.mapInArrow(_tested(shared), f"key {kind}, sha binary, points long, maybe boolean")
    # rows that may be repeated get a number, for ties between equal rows
    repeated = stored(marked.filter("maybe").drop("maybe").withColumn("row", F.monotonically_increasing_id()), "repeated")
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("key").isNull().alias("z"), F.col("key").alias("k"), F.col("row").alias("r")))
    groups = stored(repeated.groupBy("sha").agg(best.alias("best"), F.count("*").alias("group_size")), "groups")
    groups = groups.select(F.col("sha").alias("_sha"), F.col("best.k").alias("keep_id"), F.col("best.r").alias("_row"), "group_size")
    settled = repeated.join(groups, F.col("sha") == F.col("_sha"))
    settled = settled.select("key", "keep_id", "group_size", (F.col("row") == F.col("_row")).alias("kept"), "sha")
    alone = marked.filter("not maybe").select("key", F.col("key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    out = alone.union(settled)
    return out.select(F.col("key").alias(key), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that are dropped; keys identify rows, and a row without key stays."""
    own = free_name(docs.columns, "gone")
    gone = exact_groups(docs, key, text).filter("not kept").select(F.col(f"`{key}`").alias(own))
    return docs.join(gone.distinct(), F.col(f"`{key}`") == F.col(own), "left_anti")
