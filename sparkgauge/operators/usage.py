"""Model token usage: statistics per model and overall, recent calls, model lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known model keys in lookup order with family, vendor and context size.
KNOWN_MODELS = [
    ("gpt-4o", "GPT-4o", "OpenAI", 128000),
    ("gpt-4o-mini", "GPT-4o Mini", "OpenAI", 128000),
    ("gpt-4-turbo", "GPT-4 Turbo", "OpenAI", 128000),
    ("gpt-4", "GPT-4", "OpenAI", 8192),
    ("gpt-3.5-turbo", "GPT-3.5 Turbo", "OpenAI", 16384),
    ("claude-3.5-sonnet", "Claude 3.5 Sonnet", "Anthropic", 200000),
    ("claude-3-opus", "Claude 3 Opus", "Anthropic", 200000),
    ("claude-3-sonnet", "Claude 3 Sonnet", "Anthropic", 200000),
    ("claude-3-haiku", "Claude 3 Haiku", "Anthropic", 200000),
    ("o1-preview", "o1 Preview", "OpenAI", 128000),
    ("o1-mini", "o1 Mini", "OpenAI", 128000),
    ("gemini-1.5-pro", "Gemini 1.5 Pro", "Google", 2097152),
    ("gemini-1.5-flash", "Gemini 1.5 Flash", "Google", 1048576),
    ("gemini-pro", "Gemini Pro", "Google", 32768),
]
# Vendor rules for unknown ids, in order.
VENDOR_RULES = [
    ("gpt", "OpenAI", 8192),
    ("claude", "Anthropic", 200000),
    ("gemini", "Google", 32768),
    ("o1", "OpenAI", 128000),
]


def with_totals(entries: DataFrame) -> DataFrame:
    return entries.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def _stats() -> list[Column]:
    total = F.col("prompt_tokens") + F.col("completion_tokens")
    return [
        F.count("*").alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(total).alias("total_tokens"),
        F.avg(total).alias("avg_tokens_per_call"),
        F.max(total).alias("max_tokens_in_call"),
        F.min("ts_ms").alias("first_ms"),
        F.max("ts_ms").alias("last_ms"),
    ]


def usage_by_model(entries: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    return entries.groupBy(*keys).agg(*_stats())


def usage_overall(entries: DataFrame) -> DataFrame:
    """Per-model rows and the overall row (``model_id`` null), in one pass."""
    return entries.rollup("model_id").agg(*_stats())


def usage_in_range(entries: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    return entries.filter(F.col("ts_ms").between(start_ms, end_ms))


def recent_usage(entries: DataFrame, n: int) -> DataFrame:
    """Last ``n`` calls in arrival order; 0 means all."""
    if n == 0:
        return entries.orderBy("seq")
    return entries.orderBy(F.col("seq").desc()).limit(n).orderBy("seq")


def resolve_model(ids: DataFrame, column: str = "model_id") -> DataFrame:
    """Family, vendor and context size: the first known key inside the lower-cased id,
    else a vendor rule, else Unknown. Order matters: gpt-4o also catches gpt-4o-mini."""
    lower = F.lower(column)
    found = None

    def put(chain, key: str, family: Column, vendor: str, tokens: int):
        value = F.struct(family.alias("family"), F.lit(vendor).alias("vendor"), F.lit(tokens).cast("long").alias("max_tokens"))
        hit = F.contains(lower, F.lit(key))
        return F.when(hit, value) if chain is None else chain.when(hit, value)

    for key, family, vendor, tokens in KNOWN_MODELS:
        found = put(found, key, F.lit(family), vendor, tokens)
    for key, vendor, tokens in VENDOR_RULES:
        found = put(found, key, F.col(column), vendor, tokens)
    unknown = F.struct(F.col(column).alias("family"), F.lit("Unknown").alias("vendor"), F.lit(0).cast("long").alias("max_tokens"))
    return ids.withColumn("_m", found.otherwise(unknown)).select(*ids.columns, "_m.*")


def models_by_vendor(models: DataFrame, vendor: str) -> DataFrame:
    return models.filter(F.lower("vendor") == vendor.lower())


def model_vendor_summary(models: DataFrame) -> DataFrame:
    """Model count and the sorted distinct vendors (a handful of names)."""
    return models.agg(F.count("*").alias("models"), F.array_sort(F.collect_set("vendor")).alias("vendors"))


def usage_export_json(entries: DataFrame) -> DataFrame:
    """The export as JSON lines: one summary line, one per model, one per entry.

    The reference writes one document; lines keep the entries distributed.
    """
    stats = usage_overall(entries)
    fields = [c for c in stats.columns if c != "model_id"]
    summary = stats.filter("model_id is null").select(
        F.lit("summary").alias("kind"), F.to_json(F.struct("calls", "total_tokens")).alias("line")
    )
    models = stats.filter("model_id is not null").select(
        F.lit("model").alias("kind"), F.to_json(F.struct("model_id", *fields)).alias("line")
    )
    calls = with_totals(entries).select(
        F.lit("entry").alias("kind"),
        F.to_json(F.struct("ts_ms", "model_id", "prompt_tokens", "completion_tokens", "total_tokens")).alias("line"),
    )
    return summary.unionByName(models).unionByName(calls)
