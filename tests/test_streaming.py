"""A feed in several files ends in the batch answer, also after a restart."""

from pyspark.sql import functions as F

from sparkgauge.operators.usage import usage_by_model
from sparkgauge.streaming import live

SCHEMA = "seq long, ts_ms long, model_id string, prompt_tokens long, completion_tokens long"


def _feed(spark, folder, data, schema):
    """One more file, later than those before it."""
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(folder)


def test_live_usage_emits_models_and_overall_after_each_trigger(spark, tmp_path, rows):
    feed, state = str(tmp_path / "feed"), str(tmp_path / "state")
    seen = []

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(feed)
        live.run_batches(live.usage_live(stream), "update", lambda b, name: seen.append(rows(b, "kind", "model_id", "calls", "total_tokens")), state).awaitTermination()

    _feed(spark, feed, [(1, 10, "a", 1, 2), (2, 20, "b", 3, 4), (3, 30, None, 1, 0)], SCHEMA)
    run()
    assert seen == [[("model", "a", 1, 3), ("model", "b", 1, 7), ("model", None, 1, 1), ("overall", None, 3, 11)]]
    _feed(spark, feed, [(4, 40, "a", 5, 5)], SCHEMA)
    run()  # a restart goes on with the state: only what changed, and the overall row
    assert seen[1:] == [[("model", "a", 2, 13), ("overall", None, 4, 21)]]
    run()
    assert len([s for s in seen if s]) == 2
    whole = spark.read.parquet(feed)
    assert [r[2:] for s in seen[-1:] for r in s if r[0] == "overall"] in ([], [(4, 21)]) and usage_by_model(whole).count() == 3


def test_upsert_survives_a_restart(spark, tmp_path, rows):
    feed, table, state = (str(tmp_path / n) for n in ("feed", "table", "state"))
    schema = "url string, v long, seq long"

    def land(data):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(feed)

    def run():
        stream = spark.readStream.schema(schema).parquet(feed)
        live.content_stream_upsert(stream, table, state).awaitTermination()
        return rows(live.current_snapshot(spark, table), "url", "v")

    land([("a", 1, 1), ("b", 1, 1)])
    assert run() == [("a", 1), ("b", 1)]
    land([("b", 2, 2), ("c", 3, 1), ("c", 4, 2)])
    assert run() == [("a", 1), ("b", 2), ("c", 4)]
    assert run() == [("a", 1), ("b", 2), ("c", 4)]


def test_upsert_with_a_new_checkpoint_loses_nothing(spark, tmp_path, rows):
    feed, table = str(tmp_path / "feed"), str(tmp_path / "table")
    schema = "url string, v long, seq long"

    def run(state):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed)
        live.content_stream_upsert(stream, table, str(tmp_path / state)).awaitTermination()
        return rows(live.current_snapshot(spark, table), "url", "v")

    _feed(spark, feed, [(f"u{i}", i, 1) for i in range(100)], schema)
    want = [(f"u{i}", i) for i in range(100)]
    assert run("one") == sorted(want, key=repr)
    _feed(spark, feed, [("u7", 70, 2), ("new", 1, 1)], schema)
    want = sorted([x for x in want if x[0] != "u7"] + [("u7", 70), ("new", 1)], key=repr)
    assert run("one") == want
    assert run("two") == want  # all batches again, from number 0


CONSOLE = "collection_id long, seq long, ts_ms long, level string, message string, url string"
HOUR = 3_600_000


def test_console_index_appends_finished_windows_and_counts_late_rows(spark, tmp_path, rows):
    feed, main, error, state = (str(tmp_path / n) for n in ("feed", "main", "error", "state"))

    def run():
        stream = spark.readStream.schema(CONSOLE).option("maxFilesPerTrigger", 1).parquet(feed)
        q = live.write_console_index(stream, main, error, state, "1 hour", "1 hour")
        q.awaitTermination()
        return live.late_drops(q)

    def index():
        left = rows(spark.read.parquet(main), "collection_id", "n", "error_count", "warn_count", "start_ms")
        return left, rows(spark.read.parquet(error), "collection_id", "message", "n", "first_ms")

    _feed(spark, feed, [(1, 1, 100, "error", "m", "u"), (1, 2, 200, "error", "m", "u"), (1, 3, 300, "warn", "w", "u"), (2, 4, 50, "info", None, "u"), (2, 5, 60, "error", None, "u")], CONSOLE)
    assert run() == 0
    assert index() == ([], [])  # the window is still open
    _feed(spark, feed, [(1, 6, 3 * HOUR, "error", "later", "u")], CONSOLE)
    run()
    first = ([(1, 3, 2, 1, 100), (2, 2, 1, 0, 50)], [(1, "m", 2, 100), (2, "", 1, 60)])
    assert index() == first
    _feed(spark, feed, [(1, 7, 400, "error", "too late", "u")], CONSOLE)
    assert run() > 0
    late = live.late_entries(spark.read.schema(CONSOLE).parquet(feed), spark.read.parquet(main))
    assert rows(late, "collection_id", "url", "late") == [(1, "u", 1)]
    assert index() == first  # a finished window is never changed
    _feed(spark, feed, [(3, 8, 9 * HOUR, "log", "x", "u")], CONSOLE)
    run()
    assert index() == ([(1, 1, 1, 0, 3 * HOUR), *first[0]], [(1, "later", 1, 3 * HOUR), *first[1]])


def test_windows_are_counted(spark, tmp_path):
    feed = str(tmp_path / "feed")
    schema = "collection_id long, seq long, ts_ms long, level string, message string, url string"
    spark.createDataFrame([(1, i, i * 1_800_000, "error", "m", "u") for i in range(6)], schema).write.parquet(feed)
    stream = spark.readStream.schema(schema).parquet(feed)
    total = []
    q = (
        live.console_stream_counts(stream)
        .writeStream.outputMode("complete")
        .foreachBatch(lambda b, i: total.append(sorted(r["n"] for r in b.filter(F.col("level") == "error").collect())))
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    assert total[-1] == [2, 2, 2]
