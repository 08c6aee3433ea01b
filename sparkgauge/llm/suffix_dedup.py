"""Duplicate substrings by suffix sorting with a difference cover.

Every string of ``length`` bytes that also starts in a document with a smaller
key is removed where it occurs. Equal strings have equal minimisers (the least
hash of their ``GRAM``-byte substrings), so the text is cut into super-windows,
maximal runs of windows with one minimiser, and dealt by minimiser: all places of
a string meet in one partition. There the suffixes are sorted by the difference
cover modulo 3: sort the triples of the suffixes at positions 1 and 2 modulo 3,
recurse on their names while those repeat, merge the suffixes at positions 0 by
their first byte and the rank that follows; then neighbours in the order are
compared over ``length`` bytes, and the smallest key of each run of equal prefixes
decides.

Before that, a filter with "seen once" and "seen again" cells leaves out minimisers
of a single document, and equal super-windows meet as one with their smallest key
(in the task and again in the partition); copies with larger keys are removed whole.
Minimisers whose pieces all have the same smallest key hold no string of a smaller one
and are not sorted.
The filter is a bounded bit array; a full one costs time and changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgauge.llm.common import by_slices, keyed_text, mixed, shuffles_dropped, stored, text_bytes

LENGTH = 50
GRAM = 20
MAX_CELLS = 1 << 30
SLICE = 1 << 20
SLICE_BYTES = 1 << 19


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes, eight at least, from each position on that has so many."""
    n = len(raw) - gram + 1
    raw = np.ascontiguousarray(raw)
    total = np.zeros(n, np.uint64)
    for k, at in enumerate([*range(0, gram - 8, 8), gram - 8]):
        eight = np.ndarray((n,), "<u8", raw, at, (1,))  # the eight bytes from each position on
        total += eight * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1))
        total ^= total >> np.uint64(29)
    return mixed(total)


def window_least(h: np.ndarray, width: int) -> np.ndarray:
    """Least of the ``width`` values from each position on that has so many."""
    least, step = h, 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    more = width - step
    return np.minimum(least[:-more], least[more:]) if more else least


def super_windows(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(row, start, windows, minimiser) of the super-windows of a run of texts."""
    if len(raw) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    least = window_least(gram_hashes(raw, gram), length - gram + 1)
    # windows that begin too near the end of their text to fit; their grams and minimisers mean nothing
    inside = np.ones(len(least) + 1, bool)
    for a, b in zip(np.maximum(offsets[:-1], offsets[1:] - length + 1).tolist(), offsets[1:].tolist()):
        inside[a:b] = False
    inside[-1] = False
    change = np.ones(len(least) + 1, bool)
    change[1:-1] = least[1:] != least[:-1]
    # a window after one that does not fit begins anew: so does the first of each text, as the last of a text never fits
    before = np.concatenate([[False], inside[:-1]])
    new = np.flatnonzero(inside & (change | ~before))
    stop = np.flatnonzero(before & (change | ~inside))
    row = np.searchsorted(offsets, new, "right") - 1
    return row, new - offsets[row], stop - new, least[new]


def _cells(least: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(least) & np.uint64(bits - 1)).astype(np.int64)


def _seen(bits: int, length: int, gram: int):
    """Cells of the minimisers of a task, and which of them two documents have set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(held: list[np.ndarray]) -> pa.RecordBatch:
            cell, count = np.unique(np.concatenate(held), return_counts=True)
            of = cell // SLICE
            cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            ends = np.append(cut[1:], len(cell))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(of[cut], pa.int32()),
                    pa.array([np.diff(cell[a:b] % SLICE, prepend=0).astype("<u4").tobytes() for a, b in zip(cut, ends)], pa.binary()),
                    pa.array([np.packbits(count[a:b] > 1).tobytes() for a, b in zip(cut, ends)], pa.binary()),
                ],
                ["slice", "cells", "again"],
            )

        held, size = [], 0

        def work(part: pa.RecordBatch) -> list:
            nonlocal size
            row, _, _, least = super_windows(*text_bytes(part.column(1)), length, gram)
            cells = np.unique(row * bits + _cells(least, bits)) & (bits - 1)  # once a text
            held.append(cells)
            size += len(cells)
            return []

        for batch in batches:
            for _ in by_slices(work, SLICE_BYTES)([batch]):
                pass
            if size > 1 << 22:
                yield emit(held)
                held, size = [], 0
        if size:
            yield emit(held)

    return run


def _again(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    once, again = np.zeros(SLICE, bool), np.zeros(SLICE, bool)
    for batch in batches:
        for blob, twice in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            at = np.cumsum(np.frombuffer(blob, "<u4").astype(np.int64))
            many = np.unpackbits(np.frombuffer(twice, np.uint8), count=len(at)).astype(bool)
            again[at] |= once[at] | many
            once[at] = True
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(again).tobytes()], pa.binary())], ["slice", "bits"])


def repeated_filter(rows: DataFrame, n_bytes: int, length: int, gram: int) -> np.ndarray:
    """Bits of the cells that minimisers of two documents or more set; about one cell for two bytes of text."""
    bits = SLICE
    while bits < min(MAX_CELLS, n_bytes // 2):
        bits *= 2
    seen = rows.mapInArrow(_seen(bits, length, gram), "slice int, cells binary, again binary")
    merged = seen.groupBy("slice").applyInArrow(_again, "slice int, bits binary").toArrow()
    out = np.zeros(bits // 8, np.uint8)
    for k, blob in zip(merged["slice"].to_pylist(), merged["bits"].to_pylist()):
        out[k * SLICE // 8 : (k + 1) * SLICE // 8] = np.frombuffer(blob, np.uint8)
    return out


def _pieces(again, length: int, gram: int):
    """Super-windows that may be repeated: (bucket, key, start, piece)."""

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, offsets = text_bytes(part.column(1))
        row, start, count, least = super_windows(raw, offsets, length, gram)
        bits = again.value
        cell = _cells(least, len(bits) * 8)
        maybe = np.flatnonzero(bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1)
        row, start, count, least = row[maybe], start[maybe], count[maybe], least[maybe]
        sizes = count + length - 1
        ends = np.cumsum(sizes)
        first = offsets[row] + start
        flat = raw[np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        pieces = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(np.append(0, ends).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
        yield pa.RecordBatch.from_arrays(
            [pa.array(least.view(np.int64)), part.column(0).take(pa.array(row)), pa.array(start.astype(np.int32)), pieces],
            ["bucket", "key", "start", "piece"],
        )

    return by_slices(work, SLICE_BYTES)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array of positive integers by the difference cover modulo 3."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(text[i:])), np.int64)
    s = np.concatenate([text.astype(np.int64), np.zeros(3, np.int64)])
    # the suffixes at 1 and 2 modulo 3; with one past the end if n is 1 modulo 3
    one = np.arange(1, n + (n % 3 == 1), 3)
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    names, distinct = _names(s[sample], s[sample + 1], s[sample + 2])
    if distinct < len(sample):
        # recurse on the names; the first half never runs into the second, since its last name is unlike any later
        order = suffix_order(np.concatenate([names[: len(one)] + 2, [1], names[len(one) :] + 2]))
        rank_all = np.empty(len(order), np.int64)
        rank_all[order] = np.arange(len(order))
        names = np.concatenate([rank_all[: len(one)], rank_all[len(one) + 1 :]])
    order = np.argsort(names)
    ranks = np.zeros(n + 3, np.int64)
    ranks[sample[order]] = np.arange(1, len(sample) + 1)
    sorted12 = sample[order]
    sorted12 = sorted12[sorted12 < n]
    zero = np.arange(0, n, 3)
    wide = np.int64(n + 3)
    zero = zero[np.argsort(s[zero] * wide + ranks[zero + 1], kind="stable")]
    # merge: how many sampled suffixes precede each at 0 modulo 3, the two kinds by what they can be compared with
    is_one = sorted12 % 3 == 1
    ones, twos = sorted12[is_one], sorted12[~is_one]
    before = np.searchsorted(s[ones] * wide + ranks[ones + 1], s[zero] * wide + ranks[zero + 1])
    pair = int(s.max()) + 1
    if pair * pair * int(wide) < 2**63:
        two_keys, zero_keys = ((s[at] * pair + s[at + 1]) * wide + ranks[at + 2] for at in (twos, zero))
    else:  # the product would wrap: ranks of the triples instead
        at = np.concatenate([twos, zero])
        two_keys, zero_keys = np.split(_names(s[at], s[at + 1], ranks[at + 2])[0], [len(twos)])
    before = before + np.searchsorted(two_keys, zero_keys)
    out = np.empty(n, np.int64)
    place = before + np.arange(len(zero))
    taken = np.zeros(n, bool)
    taken[place] = True
    out[place] = zero
    out[~taken] = sorted12
    return out


def _names(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of triples, equal triples alike, and how many differ."""
    top = int(max(a.max(), b.max(), c.max())) + 1
    if top**3 < 2**63:
        order = np.argsort((a * top + b) * top + c)
    else:
        order = np.lexsort((c, b, a))
    a, b, c = a[order], b[order], c[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new) - 1
    return names, int(new.sum())


def repeated_windows(pieces: list[bytes], owner: np.ndarray, length: int) -> np.ndarray:
    """For each window of the pieces, in order, whether its string is in a piece with a smaller owner."""
    sizes = np.array([len(p) for p in pieces])
    parts = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) + 2
    # a separator after each piece, smaller than any byte
    ends = np.cumsum(sizes)
    text = np.insert(parts, ends, 1)
    starts = ends - sizes + np.arange(len(sizes))
    piece_of = np.repeat(np.arange(len(sizes)), sizes + 1)
    inside = np.arange(len(text)) - starts[piece_of]
    window = inside + length <= sizes[piece_of]
    order = suffix_order(text)
    order = order[window[order]]
    # neighbours share the first ``length`` bytes: compare them in steps of eight
    same = np.ones(len(order) - 1, bool) if len(order) else np.zeros(0, bool)
    low = (text - 1).astype(np.uint64)
    eight = low.copy()
    for k in range(1, 7):
        eight[: len(low) - k] |= low[k:] << np.uint64(9 * k)
    for k in [*range(0, length - 6, 7), length - 7]:
        same &= eight[order[1:] + k] == eight[order[:-1] + k]
    group = np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.zeros(0, np.int64)
    least = np.full(group[-1] + 1 if len(order) else 0, np.iinfo(np.int64).max)
    own = owner[piece_of[order]]
    np.minimum.at(least, group, own)
    out = np.zeros(len(text), bool)
    out[order] = own > least[group]
    return out[window]


def _removed(length: int, limit: int):
    """Runs of removed windows: (key, start, bytes). A partition works on whole minimisers, some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, keys, starts, pieces, size = [], [], [], [], 0

        def settle(buckets, keys, starts, pieces):
            number: dict[bytes, int] = {}
            which = np.array([number.setdefault(p, len(number)) for p in pieces])
            keys = np.concatenate(keys)
            starts = np.concatenate(starts).astype(np.int64)
            unique = list(number)
            least = np.full(len(unique), np.iinfo(np.int64).max)
            np.minimum.at(least, which, keys)
            counts = np.array([len(p) for p in unique]) - length + 1
            # a copy with a larger key goes whole
            whole = np.flatnonzero(keys > least[which])
            out = [(keys[whole], starts[whole], counts[which[whole]] + length - 1)]
            # where all pieces of a minimiser have one smallest key, none holds a string of a smaller one
            bucket = np.empty(len(unique), np.int64)
            bucket[which] = np.concatenate(buckets)
            order = np.lexsort((least, bucket))
            head = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0]))
            tail = np.append(head[1:], len(order)) - 1
            several = least[order[head]] < least[order[tail]]
            sorted_in = np.sort(order[np.repeat(several, tail - head + 1)])
            counts = counts[sorted_in]
            removed = repeated_windows([unique[i] for i in sorted_in], least[sorted_in], length) if len(sorted_in) else np.zeros(0, bool)
            begin = np.cumsum(counts) - counts
            edge = np.diff(np.concatenate([[0], removed.astype(np.int8), [0]]))
            at_begin = np.zeros(len(removed) + 1, bool)
            at_begin[np.append(begin, len(removed))] = True
            up = (edge[:-1] == 1) | at_begin[:-1] & removed
            down = (edge[1:] == -1) | at_begin[1:] & removed
            first, last = np.flatnonzero(up), np.flatnonzero(down)
            place = np.searchsorted(begin, first, "right") - 1
            of = sorted_in[place]
            kept = np.flatnonzero(keys == least[which])
            kept = kept[np.argsort(which[kept], kind="stable")]
            lo, hi = np.searchsorted(which[kept], of, "left"), np.searchsorted(which[kept], of, "right")
            many = hi - lo
            stop = np.cumsum(many)
            at = kept[np.repeat(lo - stop + many, many) + np.arange(stop[-1] if len(stop) else 0)]
            run_of = np.repeat(np.arange(len(first)), many)
            out.append((keys[at], starts[at] + first[run_of] - begin[place[run_of]], last[run_of] - first[run_of] + length))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out]), pa.int64()) for i in range(3)], ["key", "start", "n"])

        last_bucket = None
        for batch in batches:
            bucket = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(bucket, prepend=bucket[0] if last_bucket is None else last_bucket))
            last_bucket = bucket[-1]
            lengths = batch.column(3).nbytes
            # rows are sorted by minimiser: work may be cut where one ends
            if size + lengths > limit and len(cuts):
                head, batch = batch.slice(0, cuts[-1]), batch.slice(cuts[-1])
                buckets.append(head.column(0).to_numpy())
                keys.append(head.column(1).to_numpy())
                starts.append(head.column(2).to_numpy())
                pieces += head.column(3).to_pylist()
                if pieces:
                    yield settle(buckets, keys, starts, pieces)
                buckets, keys, starts, pieces, size = [], [], [], [], 0
            buckets.append(batch.column(0).to_numpy())
            keys.append(batch.column(1).to_numpy())
            starts.append(batch.column(2).to_numpy())
            pieces += batch.column(3).to_pylist()
            size += batch.column(3).nbytes
        if pieces:
            yield settle(buckets, keys, starts, pieces)

    return run


def _kept(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    raw, offsets = text_bytes(part.column(1))
    sizes = np.diff(offsets)
    runs = part.column(2)
    which = np.repeat(np.arange(len(sizes)), pc.fill_null(pc.list_value_length(runs), 0).to_numpy())
    run = runs.flatten()
    start = run.field("start").to_numpy() + offsets[which]
    # a run ends within its text, so none reaches into the next one
    cover = np.bincount(start, minlength=len(raw) + 1) - np.bincount(start + run.field("n").to_numpy(), minlength=len(raw) + 1)
    gone = np.cumsum(cover[:-1]) > 0
    begins = gone & ~np.concatenate([[False], gone[:-1]])
    begins[offsets[:-1][sizes > 0]] = gone[offsets[:-1][sizes > 0]]
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    n_removed, n_spans = total(gone), total(begins)
    rest = raw[~gone].tobytes()
    ends = np.concatenate([[0], np.cumsum(sizes - n_removed)]).tolist()
    texts = [rest[a:b] for a, b in zip(ends, ends[1:])]
    digests = [hashlib.sha256(x).hexdigest() for x in texts]
    yield pa.RecordBatch.from_arrays(
        [part.column(0), pa.array(sizes), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.binary())],
        ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
    )


def removed_runs(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, limit: int = 6 << 20) -> DataFrame:
    """(key, start, n): byte runs, overlapping, that occur in a row (key, text) with a smaller key."""
    spark = rows.sparkSession
    with shuffles_dropped(spark):
        total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        again = spark.sparkContext.broadcast(repeated_filter(rows, total, length, gram))
    pieces = rows.mapInArrow(_pieces(again, length, gram), "bucket long, key long, start int, piece binary")
    dealt = pieces.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_removed(length, limit), "key long, start long, n long")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, kept): what is left of every text, as bytes.

    Texts are UTF-8 bytes; null and empty texts have none, texts shorter than
    ``length`` lose nothing. Rows with equal keys do not remove from each other, but
    lose what either repeats; a null key counts as larger than any. Strings are judged
    on the input, so what is removed from one document still removes from later ones.
    """
    if length < GRAM + 7:
        raise ValueError(f"strings of at least {GRAM + 7} bytes")
    rows = keyed_text(docs, key, text).withColumn("key", F.col("key").cast("long"))
    numbered = rows.withColumn("key", F.coalesce("key", F.lit((1 << 63) - 1)))
    runs = removed_runs(numbered, length)
    runs = runs.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    runs = stored(runs, "removed").withColumnRenamed("key", "_k")
    found = numbered.join(runs, F.col("key") == F.col("_k"), "left").select("key", "text", "runs")
    out = found.mapInArrow(by_slices(_kept, 1 << 20), "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    real = F.when(F.col("key") < (1 << 63) - 1, F.col("key"))
    return out.select(real.alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
