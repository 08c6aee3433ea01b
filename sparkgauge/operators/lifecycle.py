"""Ticket and commit event log: imports, timelines, ticket metrics and study rollups."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgauge.functions.textfns import extract_ticket_ids
from sparkgauge.functions.timefns import diff_ms
from sparkgauge.operators.delivery import ISSUE_JSON
from sparkgauge.operators.joins import left_join_hot_right
from sparkgauge.operators.positions import with_position

CHANGELOG_JSON = (
    "key string, histories array<struct<created:timestamp,"
    "items:array<struct<field:string,fromString:string,toString:string>>>>"
)


# ---- imports


def status_category(key: Column) -> Column:
    return F.when(key == "done", "Done").when(key == "new", "To Do").otherwise("In Progress")


def issue_to_ticket(raw: DataFrame, study: Column, column: str = "raw") -> DataFrame:
    """Issue JSON text to ticket rows."""
    issue = raw.select("*", F.from_json(column, ISSUE_JSON).alias("i"))
    f = "i.fields."
    return issue.select(
        study.alias("case_study_id"),
        F.col("i.id").alias("jira_id"),
        F.col("i.key").alias("ticket_key"),
        F.col(f + "summary").alias("summary"),
        F.col(f + "description").alias("description"),
        F.col(f + "issuetype.name").alias("issue_type"),
        F.col(f + "priority.name").alias("priority"),
        F.col(f + "status.name").alias("current_status"),
        status_category(F.col(f + "status.statusCategory.key")).alias("status_category"),
        F.col(f + "assignee.accountId").alias("assignee_id"),
        F.col(f + "assignee.displayName").alias("assignee"),
        F.col(f + "reporter.accountId").alias("reporter_id"),
        F.col(f + "reporter.displayName").alias("reporter"),
        F.col(f + "customfield_10104").alias("sprint"),
        F.col(f + "customfield_10016").alias("story_points"),
        F.col(f + "created").alias("created_at"),
        F.col(f + "updated").alias("updated_at"),
        F.col(f + "resolutiondate").alias("resolved_at"),
    )


def import_issues(raw: DataFrame, study: Column, column: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Tickets, and their created and resolved events (actor of a resolution: the assignee)."""
    tickets = issue_to_ticket(raw, study, column)

    def event(kind: str, at: str, actor: Column, actor_id: str) -> Column:
        return F.struct(
            F.lit(kind).alias("event_type"),
            F.col(at).alias("event_date"),
            actor.alias("actor_name"),
            F.col(actor_id).alias("actor_id"),
        )

    both = F.array(
        event("ticket_created", "created_at", F.col("reporter"), "reporter_id"),
        event("resolved", "resolved_at", F.coalesce("assignee", F.lit("Unknown")), "assignee_id"),
    )
    events = tickets.select(
        "case_study_id",
        "ticket_key",
        F.lit("jira").alias("event_source"),
        F.inline(F.filter(both, lambda e: e["event_date"].isNotNull())),
    )
    return tickets, events


def import_changelog(raw: DataFrame, study: Column, column: str = "raw") -> DataFrame:
    """Status and assignee items of every history as events; other fields are ignored."""
    log = raw.select("*", F.from_json(column, CHANGELOG_JSON).alias("c"))
    histories = log.select(study.alias("case_study_id"), F.col("c.key").alias("ticket_key"), F.explode("c.histories").alias("h"))
    items = histories.select("case_study_id", "ticket_key", F.col("h.created").alias("event_date"), F.explode("h.items").alias("i"))
    is_status = F.col("i.field") == "status"
    return items.filter(F.col("i.field").isin("status", "assignee")).select(
        "case_study_id",
        "ticket_key",
        F.when(is_status, "status_changed").otherwise("assignee_changed").alias("event_type"),
        F.lit("jira").alias("event_source"),
        "event_date",
        F.lit("Jira User").alias("actor_name"),
        F.when(is_status, F.nullif(F.col("i.fromString"), F.lit(""))).alias("from_status"),
        F.when(is_status, F.nullif(F.col("i.toString"), F.lit(""))).alias("to_status"),
    )


def import_commits(
    commits: DataFrame, since: datetime | None = None, until: datetime | None = None, max_commits: int | None = None
) -> DataFrame:
    """One event per commit and ticket named in its message.

    ``max_commits`` is the importer's own stop: the newest that many commits that name a
    ticket. Without it every commit counts.
    """
    if since:
        commits = commits.filter(F.col("committed_at") >= since)
    if until:
        commits = commits.filter(F.col("committed_at") <= until)
    naming = commits.withColumn("tickets", extract_ticket_ids(F.col("message"))).filter(F.size("tickets") > 0)
    if max_commits:
        naming = naming.orderBy(F.col("committed_at").desc(), "sha").limit(max_commits)
    return naming.select(
        "case_study_id",
        F.explode("tickets").alias("ticket_key"),
        F.lit("commit_created").alias("event_type"),
        F.lit("github").alias("event_source"),
        F.col("committed_at").alias("event_date"),
        F.col("author_name").alias("actor_name"),
        F.col("sha").alias("commit_sha"),
        F.col("message").alias("commit_message"),
    )


def union_events(*logs: DataFrame) -> DataFrame:
    whole = logs[0]
    for more in logs[1:]:
        whole = whole.unionByName(more, allowMissingColumns=True)
    return whole


# ---- lookups


def _equal(df: DataFrame, order: Column, **wanted) -> DataFrame:
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df.orderBy(order)


def tickets_by(tickets: DataFrame, study=None, status=None, category=None, sprint=None) -> DataFrame:
    return _equal(
        tickets,
        F.col("created_at"),
        case_study_id=study,
        current_status=status,
        status_category=category,
        sprint=sprint,
    )


def events_by(
    events: DataFrame, study=None, ticket=None, kind=None, source=None, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    if start:
        events = events.filter(F.col("event_date") >= start)
    if end:
        events = events.filter(F.col("event_date") <= end)
    return _equal(
        events, F.col("event_date"), case_study_id=study, ticket_key=ticket, event_type=kind, event_source=source
    )


def studies_by(studies: DataFrame, status=None, kind=None) -> DataFrame:
    return _equal(studies, F.col("imported_at").desc(), status=status, type=kind)


def ticket_events(tickets: DataFrame, events: DataFrame, same_study: bool = True) -> DataFrame:
    """Events of each ticket. The reference matches on the ticket key alone, which leaks
    across studies; pass ``same_study=False`` for that."""
    keys = ["case_study_id", "ticket_key"] if same_study else ["ticket_key"]
    other = events if same_study else events.drop("case_study_id")
    return left_join_hot_right(tickets.select("case_study_id", "ticket_key"), other, keys)


def correlated_tickets(tickets: DataFrame, events: DataFrame) -> DataFrame:
    """Tickets with at least one jira and one github event."""
    seen = events.groupBy("ticket_key").agg(
        F.bool_or(F.col("event_source") == "jira").alias("j"), F.bool_or(F.col("event_source") == "github").alias("g")
    )
    return tickets.join(seen.filter("j and g"), "ticket_key", "left_semi")


def ticket_timeline(events: DataFrame) -> DataFrame:
    """Events of each ticket in date order as rows with ``position`` and ``total``.

    Rows, not one array per ticket: a ticket that owns a third of the log stays spread.
    """
    return with_position(events, ["ticket_key"], [F.col("event_date"), F.col("id")])


# ---- metrics


def ticket_metrics(tickets: DataFrame, events: DataFrame, same_study: bool = True) -> DataFrame:
    """Lead time (created to resolved) and cycle time (first Progress to first Done change), in ms.

    A missing end leaves null; the cycle may be negative. Events collapse to two dates per
    ticket before the join.
    """
    keys = ["case_study_id", "ticket_key"] if same_study else ["ticket_key"]
    changed = events.filter(F.col("event_type") == "status_changed")

    def first(word: str) -> Column:
        return F.min(F.when(F.contains("to_status", F.lit(word)), F.col("event_date")))

    dates = changed.groupBy(*keys).agg(first("Progress").alias("_progress"), first("Done").alias("_done"))
    return tickets.join(dates, keys, "left").select(
        *tickets.columns,
        diff_ms(F.col("resolved_at"), F.col("created_at")).alias("lead_time"),
        diff_ms(F.col("_done"), F.col("_progress")).alias("cycle_time"),
    )


def average_metrics(measured: DataFrame, by: Sequence[str] = ("case_study_id",)) -> DataFrame:
    """Averages over resolved tickets; no value counts as 0 in the answer, not in the mean."""
    fields = ["lead_time", "cycle_time", "story_points"]
    return (
        measured.filter(F.col("resolved_at").isNotNull())
        .groupBy(*by)
        .agg(*[F.coalesce(F.avg(f), F.lit(0.0)).alias(f"avg_{f}") for f in fields])
    )


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def tickets_by_status_count(tickets: DataFrame) -> DataFrame:
    return count_by(tickets, "case_study_id", "current_status")


def events_by_type_count(events: DataFrame) -> DataFrame:
    return count_by(events, "case_study_id", "event_type")


def events_by_source_count(events: DataFrame) -> DataFrame:
    return events.groupBy("case_study_id").agg(
        F.count_if(F.col("event_source") == "jira").alias("jira"),
        F.count_if(F.col("event_source") == "github").alias("github"),
    )


def studies_by_status_count(studies: DataFrame) -> DataFrame:
    return count_by(studies, "status")


def study_rollup(tickets: DataFrame, events: DataFrame) -> DataFrame:
    """Ticket and event counts and the span of ticket creation, per study."""
    stacked = tickets.select("case_study_id", F.col("created_at").alias("at"), F.lit(1).alias("t"), F.lit(0).alias("e"))
    stacked = stacked.unionByName(
        events.select(
            "case_study_id", F.lit(None).cast("timestamp").alias("at"), F.lit(0).alias("t"), F.lit(1).alias("e")
        )
    )
    return stacked.groupBy("case_study_id").agg(
        F.sum("t").alias("ticket_count"),
        F.sum("e").alias("event_count"),
        F.min("at").alias("start_date"),
        F.max("at").alias("end_date"),
    )


def metrics_summary(measured: DataFrame, events: DataFrame, prs: DataFrame) -> DataFrame:
    """One row: tickets, completed, mean times, commits, pull requests, points completed."""
    done = F.col("status_category") == "Done"
    parts = (
        measured.agg(
            F.count("*").alias("total_tickets"),
            F.count_if(done).alias("completed_tickets"),
            F.coalesce(F.avg("cycle_time"), F.lit(0.0)).alias("avg_cycle_time"),
            F.coalesce(F.avg("lead_time"), F.lit(0.0)).alias("avg_lead_time"),
            F.coalesce(F.sum(F.when(done, F.col("story_points"))), F.lit(0.0)).alias("velocity_points"),
        )
        .unionByName(events.agg(F.count_if(F.col("event_type") == "commit_created").alias("total_commits")), True)
        .unionByName(prs.agg(F.count("*").alias("total_prs")), True)
    )
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])
