"""Scoring of predictions and of matching and categorization results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgauge.functions.scoring import index_score, score_boolean, score_graded
from sparkgauge.operators.joins import skew_join


def score_predictions(predictions: DataFrame) -> DataFrame:
    """Detail rows with ``passed``; a missing prediction (an error) fails."""
    passed = score_boolean(F.col("predicted"), F.col("expected"))
    return predictions.withColumn("passed", F.coalesce(passed, F.lit(False)))


def prompt_accuracy(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    share = F.coalesce(F.try_divide(F.count_if("passed"), F.count("*")), F.lit(0.0))
    return scored.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        share.alias("accuracy"),
    )


def compare_runs(scored: DataFrame) -> DataFrame:
    return prompt_accuracy(scored, ["run"]).orderBy(F.col("accuracy").desc(), "run")


def mean_metric(
    predictions: DataFrame, metric: Callable[[Column, Column], Column] = score_graded, by: Sequence[str] = ()
) -> DataFrame:
    """Mean of a scoring function of (prediction, expected); a failure scores 0.

    ``metric`` is the user's own scoring: any function of two Columns, or a pandas UDF.
    """
    score = metric(F.col("predicted"), F.col("expected")).cast("double")
    return predictions.groupBy(*by).agg(
        F.coalesce(F.avg(F.coalesce(score, F.lit(0.0))), F.lit(0.0)).alias("score"), F.count("*").alias("n")
    )


def index_accuracy(examples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    score = index_score(F.col("gold_index"), F.col("pred_index"), F.col("confidence"))
    return examples.groupBy(*by).agg(F.coalesce(F.avg(score), F.lit(0.0)).alias("accuracy"), F.count("*").alias("n"))


def eval_categorization(cats: DataFrame) -> DataFrame:
    """One row; counts per category fold first, so the distribution map holds categories only."""
    c = F.col("confidence")
    per = cats.groupBy("category").agg(
        F.count("*").alias("n"),
        F.sum(c).alias("s"),
        F.min(c).alias("lo"),
        F.max(c).alias("hi"),
        F.count_if(c < 0.5).alias("low"),
    )
    spread = F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n"))))
    zero = F.lit(0.0)
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.try_divide(F.sum("s"), F.sum("n")), zero).alias("avg_confidence"),
        F.coalesce(F.min("lo"), zero).alias("min_confidence"),
        F.coalesce(F.max("hi"), zero).alias("max_confidence"),
        F.count("*").alias("unique_categories"),
        spread.alias("distribution"),
        F.coalesce(F.sum("low"), F.lit(0)).alias("low_confidence"),
    )


def eval_matching(matchings: DataFrame) -> DataFrame:
    matched = F.col("content_id").isNotNull()
    score = F.when(matched, F.col("similarity_score"))
    zero = F.lit(0.0)
    return matchings.agg(
        F.count("*").alias("n"),
        F.count_if(matched).alias("matched"),
        F.count_if(~matched).alias("unmatched"),
        F.coalesce(F.try_divide(F.count_if(matched), F.count("*")), zero).alias("match_rate"),
        F.coalesce(F.avg(score), zero).alias("avg_similarity"),
        F.coalesce(F.min(score), zero).alias("min_similarity"),
        F.coalesce(F.max(score), zero).alias("max_similarity"),
    )


def matched_categorizations(matchings: DataFrame, cats: DataFrame) -> DataFrame:
    """Categorizations of every matched content, once per match.

    A content with very many matches is cut into parts by its counted matches.
    """
    matched = matchings.filter(F.col("content_id").isNotNull()).select("content_id", F.col("id").alias("_match"))
    return skew_join(matched, cats, ["content_id"]).select(*cats.columns)


def eval_all(matchings: DataFrame, cats: DataFrame) -> DataFrame:
    """Both evaluations as one row, weighting each categorization by its matches instead
    of repeating it."""
    times = matchings.filter(F.col("content_id").isNotNull()).groupBy("content_id").agg(F.count("*").alias("w"))
    per = cats.join(times, "content_id").agg(
        F.coalesce(F.sum("w"), F.lit(0)).alias("cat_n"),
        F.coalesce(F.try_divide(F.sum(F.col("confidence") * F.col("w")), F.sum("w")), F.lit(0.0)).alias("cat_avg_confidence"),
        F.count_distinct("category").alias("cat_unique"),
        F.coalesce(F.sum(F.when(F.col("confidence") < 0.5, F.col("w"))), F.lit(0)).alias("cat_low_confidence"),
    )
    stacked = per.unionByName(eval_matching(matchings), True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def low_quality_matches(matchings: DataFrame, threshold: float = 0.7) -> DataFrame:
    return matchings.filter(F.col("content_id").isNotNull() & (F.col("similarity_score") < threshold))


def unmatched_results(matchings: DataFrame) -> DataFrame:
    return matchings.filter(F.col("content_id").isNull())
