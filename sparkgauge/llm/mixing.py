"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target over
source size. The prefix sum of expected copies runs over the documents of a
source in order of size; one random offset is added, and a document is emitted
once for each integer that its step crosses. Neighbours in that order have
about the same size, so the words taken come within about one document of the
target.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgauge.llm.common import by_slices, free_name, keyed_text, stored, text_bytes
from sparkgauge.operators.positions import with_position

WEIGHTS = (5, 2, 1)
CAP = 3


def _sizes(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    raw, offsets = text_bytes(part.column(2))
    raw = raw.tobytes()
    words = [len(raw[a:b].split()) for a, b in zip(offsets[:-1], offsets[1:])]  # ASCII white space, as for bytes
    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(words, pa.int64())], ["key", "source", "size"])


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources by code point, null last, weigh ``weights`` in turn and share all words;
    a target stops at ``cap`` times its source's size and the excess is shared anew
    until none is above. The sources may be many: each round is one aggregate over
    them and the driver sees a few sums.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    totals = totals.withColumn("one", F.lit(1))
    ranked = with_position(totals, ["one"], [F.col("source").asc_nulls_last()])
    weight = F.array(*[F.lit(w) for w in weights])[F.pmod("position", F.lit(len(weights))).cast("int")]
    ranked = stored(ranked.select("source", "source_size", weight.cast("long").alias("weight")), "sources")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    capped = F.lit(False)
    full = F.lit(0.0)
    count = -1
    while True:
        row = ranked.agg(
            F.coalesce(F.sum(F.when(capped, F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)),
            F.count(F.when(capped, 1)),
        ).first()
        # the bound only rises, so what is above once stays above
        bound = (total - cap * row[0]) / row[1] if row[1] else 0.0
        if row[2] == count:
            break
        count, full = row[2], F.lit(bound)
        capped = full * F.col("weight") > cap * F.col("source_size")
    target = F.when(capped, (cap * F.col("source_size")).cast("double")).otherwise(full * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """(key, source, size, source_size, target, copies, taken): how often the mix takes each document.

    Size counts runs of characters other than ASCII white space; null and empty texts
    have size 0 and follow their source's rate, which takes no words from them. A
    source without words has target 0 and takes nothing. Ties in size go by key, so
    reruns agree; repeated rows are rows of their own. Sources may be null.
    """
    rows = keyed_text(docs, key, text, source).select("key", F.col(f"in_{source}").cast("string").alias("source"), "text")
    kind = rows.schema["key"].dataType.simpleString()
    sizes = stored(rows.mapInArrow(by_slices(_sizes), f"key {kind}, source string, size long"), "sizes")
    targets = stored(source_targets(sizes, weights, cap), "targets").withColumnRenamed("source", "_s")
    placed = with_position(sizes, ["source"], [F.col("size"), F.col("key")])
    placed = placed.join(targets, F.col("source").eqNullSafe(F.col("_s")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    digest = F.md5(F.concat(F.lit(seed), F.coalesce("source", F.lit(""))).cast("binary"))
    offset = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    step = lambda at: F.floor(at * F.col("rate") + F.col("offset"))
    placed = placed.withColumn("rate", rate).withColumn("offset", offset)
    copies = (step(F.col("position") + 1) - step(F.col("position"))).cast("long")
    placed = placed.withColumn("copies", copies)
    return placed.select(
        F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def take(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
         weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; keys identify rows."""
    taken = mix(docs, key, text, source, weights, cap, seed)
    name, times = free_name(docs.columns, "of_key"), free_name(docs.columns, "times")
    taken = taken.filter("copies > 0").groupBy(F.col(f"`{key}`").alias(name)).agg(F.max("copies").alias(times))
    out = docs.join(taken, F.col(f"`{key}`").eqNullSafe(F.col(name)))
    copy = free_name(out.columns, "copy")
    out = out.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
