"""Streaming versions of the incremental operators.

State is the aggregate, never the entries, so it grows with models, urls and windows.
"""

from __future__ import annotations

from collections.abc import Callable
from threading import Event

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkgauge.operators.logs import LEVELS
from sparkgauge.operators.usage import usage_by_model
from sparkgauge.session import scratch_path
from sparkgauge.sources.tablework import upsert_by_url

BUCKETS = 64  # of an upserted table; a batch rewrites those that its urls fall into


def usage_live(entries: DataFrame) -> DataFrame:
    """Per-model statistics of a stream, and those of all models as the row of kind ``overall``.

    Every call counts under its model and under a null model. Both are one aggregate, so a
    trigger in output mode ``update`` emits the models it touched and the overall row
    together. The overall row combines map-side and costs one row a task.
    """
    both = F.array(F.struct(F.lit("model").alias("kind"), "model_id"), F.struct(F.lit("overall").alias("kind"), F.lit(None).cast("string").alias("model_id")))
    counted = entries.select("ts_ms", "prompt_tokens", "completion_tokens", F.inline(both))
    return usage_by_model(counted, ["kind", "model_id"])


def console_stream_counts(entries: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Entry counts per url, level and time window; for any output mode."""
    timed = entries.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", late)
    counted = timed.groupBy(F.window("at", width).alias("w"), "url", "level").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "url", "level", "n")


def console_stream_index(entries: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Main and error index of a stream in one aggregate, for output mode ``append``.

    A row of kind ``main`` has one capture's entries in a time window: counts per level,
    first and last time. A row of kind ``error`` has one error message of it. A window is
    emitted once, when the watermark (``late`` behind the newest entry) passes its end, and
    then leaves the state. Later entries of it are dropped; ``late_entries`` counts them.
    """
    timed = entries.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", late)
    main = F.struct(F.lit("main").alias("kind"), F.lit(None).cast("string").alias("error"))
    error = F.when(F.col("level") == "error", F.struct(F.lit("error").alias("kind"), F.coalesce("message", F.lit("")).alias("error")))
    listed = timed.select("at", "ts_ms", "collection_id", "url", "level", F.inline(F.array_compact(F.array(main, error))))
    counts = [F.count_if(F.col("level") == x).alias(f"{x}_count") for x in LEVELS]
    found = listed.groupBy(F.window("at", width).alias("w"), "kind", "collection_id", "url", "error").agg(
        F.count("*").alias("n"), F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), *counts
    )
    return found.select(F.col("w.start").alias("start"), *[c for c in found.columns if c != "w"])


def write_console_index(
    entries: DataFrame, main_path: str, error_path: str, checkpoint: str, late: str = "1 hour", width: str = "1 hour"
) -> StreamingQuery:
    """Run ``console_stream_index`` over all that is there and append its rows to two tables.

    A batch writes folders of its own, named after the query and its number, so a batch
    that is repeated after a failure replaces itself, and a new checkpoint replaces nothing.
    """

    def save(batch: DataFrame, name: str) -> None:
        errors = ["start", "collection_id", "url", F.col("error").alias("message"), "n", F.col("start_ms").alias("first_ms")]
        batch.filter("kind = 'main'").drop("kind", "error").write.mode("overwrite").parquet(f"{main_path}/run={name}")
        batch.filter("kind = 'error'").select(*errors).write.mode("overwrite").parquet(f"{error_path}/run={name}")

    return run_batches(console_stream_index(entries, late, width), "append", save, checkpoint)


def run_batches(stream: DataFrame, mode: str, work: Callable[[DataFrame, str], None], checkpoint: str) -> StreamingQuery:
    """Call ``work(batch, name)`` for every batch of all that is there; names do not repeat across checkpoints."""
    started, ids = Event(), []

    def step(batch: DataFrame, number: int) -> None:
        started.wait()
        work(batch, f"{ids[0]}-{number:010d}")

    query = stream.writeStream.outputMode(mode).foreachBatch(step)
    query = query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    ids.append(query.id)
    started.set()
    return query


def late_drops(query: StreamingQuery) -> int:
    """Spark's measure of what the query's recent batches dropped behind the watermark: above 0 when
    something was late. It counts rows combined by task and group, and may count one twice;
    ``late_entries`` counts entries."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def late_entries(entries: DataFrame, main: DataFrame, width: str = "1 hour") -> DataFrame:
    """(start, collection_id, url, late): entries of finished windows that came too late for the main index.

    A batch audit of the archived feed against the index it made; both sides are counts per window.
    """
    keys = ["start", "collection_id", "url"]
    timed = entries.groupBy(F.window(F.timestamp_millis("ts_ms"), width).alias("w"), "collection_id", "url").agg(F.count("*").alias("n"))
    came = timed.select(F.col("w.start").alias("start"), "collection_id", "url", "n")
    counted = main.select(*keys, (-F.col("n")).alias("n"))
    left = came.unionByName(counted).groupBy(*keys).agg(F.sum("n").alias("late")).filter("late > 0")
    return left.filter(F.col("start") <= main.agg(F.max("start")).scalar())


def content_stream_upsert(incoming: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Upsert each micro-batch by url into a table of BUCKETS folders by hash of the url.

    A batch reads and replaces only the folders its urls fall into. Repeating a batch, or
    all of them with a new checkpoint, ends in the same rows. Readers beside a running
    batch may see some folders before and some after it: there is no ACID table here.
    """
    bucketed = incoming.withColumn("bucket", F.pmod(F.xxhash64("url"), F.lit(BUCKETS)).cast("int"))

    def merge(batch: DataFrame, name: str) -> None:
        spark = batch.sparkSession
        path = scratch_path(spark, f"upsert-{name}")
        batch.write.parquet(path)  # a batch is read once
        batch = spark.read.schema(batch.schema).parquet(path)
        touched = [r[0] for r in batch.select("bucket").distinct().collect()]  # BUCKETS numbers at most
        batch.limit(0).write.mode("append").partitionBy("bucket").parquet(table_path)  # the folder exists from here on
        stored = spark.read.schema(batch.schema).parquet(table_path).filter(F.col("bucket").isin(touched))
        merged = scratch_path(spark, f"merged-{name}")
        upsert_by_url(stored, batch).write.parquet(merged)
        done = spark.read.schema(batch.schema).parquet(merged)
        out = done.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("bucket").parquet(table_path)

    return run_batches(bucketed, "append", merge, checkpoint)


def current_snapshot(spark: SparkSession, table_path: str) -> DataFrame:
    """The rows of an upserted table."""
    return spark.read.parquet(table_path).drop("bucket")
