"""Table maintenance without an ACID table: upserts, deletes and appends as new frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _upsert(target: DataFrame, incoming: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """Target rows whose key is not incoming, and the last incoming row per key.

    Only keys meet in the anti join, so a small batch is broadcast (Spark checks its size)
    and the target is not shuffled. The last row per key is a max aggregate that combines
    map-side: many versions of one key cost one row per partition.
    """
    fields = incoming.columns
    newest = incoming.groupBy(key.alias("_key")).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_row"))
    keys = newest.select("_key")
    kept = target.withColumn("_key", key).join(keys, "_key", "left_anti").drop("_key")
    return kept.unionByName(newest.select("_row.*"), allowMissingColumns=True)


def upsert_by_url(target: DataFrame, incoming: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Insert or replace by url; among incoming rows of one url the highest ``order`` wins."""
    return _upsert(target, incoming, F.col("url"), order)


def upsert_matching(target: DataFrame, incoming: DataFrame, order: Sequence[str] = ("created_ms", "id")) -> DataFrame:
    """Insert or replace by (taxonomy_id, content_id).

    A unique index ignores nulls, so the reference piles up unmatched rows; here a null
    content is a key of its own and one unmatched row per taxonomy remains.
    """
    key = F.struct("taxonomy_id", F.coalesce(F.col("content_id").cast("string"), F.lit("∅")).alias("c"))
    return _upsert(target, incoming, key, order)


def clear_matching(
    matchings: DataFrame, taxonomy_ids: DataFrame | None = None, stages: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(kept, deleted). Filters combine with and; none at all deletes everything."""
    hit = F.lit(True)
    marked = matchings
    if stages is not None:
        hit = hit & F.coalesce(F.col("match_stage").isin(list(stages)), F.lit(False))
    if taxonomy_ids is not None:
        ids = taxonomy_ids.select(F.col("taxonomy_id").alias("_tid"), F.lit(True).alias("_in")).distinct()
        marked = matchings.join(ids, F.col("taxonomy_id") == F.col("_tid"), "left")
        hit = hit & F.coalesce("_in", F.lit(False))
    marked = marked.select(*matchings.columns, hit.alias("_hit"))
    return marked.filter(~F.col("_hit")).drop("_hit"), marked.filter("_hit").drop("_hit")


def cascade_delete(doomed: DataFrame, key: str, *children: DataFrame) -> tuple[DataFrame, ...]:
    """Each child without the rows of the deleted parents."""
    return tuple(child.join(doomed, key, "left_anti") for child in children)


def bulk_insert(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append; an empty frame writes no rows."""
    rows.write.mode("append").format(fmt).save(path)
