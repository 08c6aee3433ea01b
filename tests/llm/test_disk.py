"""Shuffle files of finished steps are deleted, and do not wait for the driver's garbage collection."""

import random
import time

from pyspark.sql import functions as F

from sparkgauge.llm import line_dedup, suffix_dedup
from sparkgauge.llm.common import CLEANUP, stored


def shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {x for x in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}


def left_after(spark, work):
    """Shuffle files that ``work`` leaves; they are deleted in the background."""
    before = shuffle_files(spark)
    kept = work()
    for _ in range(40):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.25)
    return kept, left


def test_stored_leaves_no_shuffle_files(spark):
    rows = spark.range(1000).repartition(3, "id").groupBy("id").count()
    setting = spark.conf.get(CLEANUP)
    (frame, again), left = left_after(spark, lambda: (stored(rows, "a"), stored(rows, "b")))
    assert not left and spark.conf.get(CLEANUP) == setting
    assert frame.count() == again.count() == 1000


def test_suffix_dedup_leaves_no_pieces(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choices("abcdef", k=300)) for _ in range(20)]
    docs = spark.createDataFrame([(i, texts[i % 20]) for i in range(40)], "doc_id long, text string")
    out, left = left_after(spark, lambda: suffix_dedup.remove_repeats(docs))
    assert not left
    assert {r["doc_id"]: r["n_removed"] for r in out.collect()} == {i: 300 * (i >= 20) for i in range(40)}


def test_line_dedup_fetches_no_words_for_pairs_that_signatures_tell_apart(spark, monkeypatch):
    tables = {}
    plain = line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", lambda df, name, **o: tables.setdefault(name, plain(df, name, **o)))
    words = [f"w{i}" for i in range(400)]
    lines = [" ".join(words[:40]), " ".join(words[1:40]), " ".join(words[40:80])]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    forced = []
    real = line_dedup.similar_sets

    def all_pairs(sets, percent):
        forced.append(real(sets, percent).count())
        a, b = sets.select(F.col("sid").alias("a")), sets.select(F.col("sid").alias("b"))
        return a.join(b, a["a"] < b["b"])

    monkeypatch.setattr(line_dedup, "similar_sets", all_pairs)
    got, left = left_after(spark, lambda: line_dedup.repeated_lines(docs))
    assert {r["doc_id"]: list(r["removed"]) for r in got.collect()} == {0: [], 1: [0], 2: []}
    assert not left and forced == [1]
    assert tables["line-pairs"].count() == 3 and tables["line-near"].count() == 1
