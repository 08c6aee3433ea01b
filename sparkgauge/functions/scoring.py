"""Scores of a prediction against the expected text or index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkgauge.functions.textfns import strip_space, words


def word_overlap(predicted: Column, expected: Column) -> Column:
    """Share of the distinct expected words that occur in the prediction."""
    wanted = words(expected)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(words(predicted), wanted)), F.size(wanted)), F.lit(0.0))


def _clean(text: Column) -> Column:
    return F.lower(strip_space(text))


def _either_way(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def score_boolean(predicted: Column, expected: Column) -> Column:
    """Equal; else false when one is empty; else substring either way; else overlap over 0.7."""
    p, e = _clean(predicted), _clean(expected)
    return (
        F.when(p == e, True)
        .when((p == "") | (e == ""), False)
        .when(_either_way(p, e), True)
        .otherwise(word_overlap(p, e) > 0.7)
    )


def score_graded(predicted: Column, expected: Column) -> Column:
    """1 equal, 0.5 substring either way (an empty text is in every text), else 0.3 of the overlap."""
    p, e = _clean(predicted), _clean(expected)
    return F.when(p == e, 1.0).when(_either_way(p, e), 0.5).otherwise(word_overlap(p, e) * 0.3)


def index_score(gold: Column, predicted: Column, confidence: Column) -> Column:
    """1 for the right index. A confident miss is penalised by 0.2 but never below 0."""
    right = F.when(predicted.try_cast("int") == gold.try_cast("int"), 1.0).otherwise(0.0)
    penalty = F.when((right == 0.0) & (confidence > 0.8), 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.0), right - penalty)
