"""Declared value rules of the stored tables, and the rows that break them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Allowed words and ranges of the stored tables.
ALLOWED = {
    "case_studies": {"type": ["project", "sprint", "ticket"], "status": ["importing", "completed", "error"]},
    "jira_tickets": {"status_category": ["To Do", "In Progress", "Done"]},
    "lifecycle_events": {
        "event_type": [
            "ticket_created",
            "status_changed",
            "assignee_changed",
            "sprint_assigned",
            "comment_added",
            "resolved",
            "commit_created",
            "branch_created",
            "pr_opened",
            "pr_reviewed",
            "pr_approved",
            "pr_merged",
            "deployed_to_branch",
        ],
        "event_source": ["jira", "github"],
    },
    "matchings": {"match_stage": ["semantic_matched", "llm_categorized", "needs_human_review"]},
    "deployments": {"status": ["success", "failure", "in_progress", "pending", "queued"]},
    "console_entries": {"level": ["log", "info", "warn", "error", "debug"]},
}
RANGES = {"matchings": {"similarity_score": (0.0, 1.0)}, "categorizations": {"confidence": (0.0, 1.0)}}


def violations(df: DataFrame, table: str) -> DataFrame:
    """Rows of a table with ``violated``, the names of the columns that break a rule.

    A null breaks no rule. The test is one filter, so it costs no shuffle at ingest.
    """
    tests: dict[str, Column] = {c: F.col(c).isin(words) for c, words in ALLOWED.get(table, {}).items()}
    tests |= {c: F.col(c).between(*bounds) for c, bounds in RANGES.get(table, {}).items()}
    if not tests:
        raise ValueError(f"no rules for table {table!r}")
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(c)) for c, ok in sorted(tests.items())]))
    return df.withColumn("violated", broken).filter(F.size("violated") > 0)
