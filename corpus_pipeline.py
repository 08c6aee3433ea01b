"""A corpus pipeline over ``documents``: every stage reads all that the one before kept.

Stages are (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``.
Stages handle null, empty and very long texts, ties, repeated rows, empty tables
and further columns as their operators state; columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.llm import decontam, langid, mixing, ngram_join, rans
from sparkgauge.llm.common import free_name, stored, table
from sparkgauge.llm.queries import vocabulary_file


KEEP: frozenset[str] | None = None  # languages that stay; None stands for all that the model knows


def language(spark: SparkSession, docs: DataFrame, sf_dir: str, keep: frozenset[str] | None = KEEP) -> DataFrame:
    """Drop documents without a language (null texts, texts without a letter) and those predicted outside ``keep``.

    Without any labelled row there is no model, and nothing is dropped.
    """
    model = langid.train(docs)
    if not model.families:
        return docs
    lang = free_name([*docs.columns, "lang_pred", "score"], "of_text")
    texts = docs.withColumn(lang, F.col("text"))  # columns of the operator's names stay what they are
    judged = langid.with_language(texts.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), lang), model, lang)
    kept = F.col("lang_pred") != langid.UNKNOWN
    if keep is not None:
        kept = F.col("lang_pred").isin(*keep)
    return judged.filter(kept).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies: five words and 0.8, where op10 has four and 0.85."""
    return ngram_join.keep_first(docs, n=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold test items."""
    own = free_name(docs.columns, "of_row")
    # ids may be null or repeat, and rows of one id and text are alike
    row = F.to_json(F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text")))
    docs = docs.withColumn(own, row)
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), own)
    gone = found.filter("contaminated").select(own).distinct()
    return docs.join(gone, own, "left_anti").drop(own)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that sources come near their target weights."""
    return mixing.take(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files and return what they hold for each document."""
    return rans.round_trip(docs, vocabulary_file())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_files", token_files),
]

# Fitted models, a random offset per source and a vocabulary file are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
