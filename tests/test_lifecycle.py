import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from sparkgauge.functions.textfns import extract_ticket_ids
from sparkgauge.operators import lifecycle as lc
from sparkgauge.operators import usage as u

UTC = timezone.utc


def when(text):
    return datetime.fromisoformat(text).replace(tzinfo=UTC)


def test_ticket_ids_are_distinct_in_first_seen_order(spark):
    texts = ["KAFKA-12 then AB1-3, KAFKA-12", "lower kafka-1 xKAFKA-2 A-1", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(extract_ticket_ids(F.col("t"))).collect()] == [["KAFKA-12", "AB1-3"], [], [], None]


def changelog(spark):
    def history(created, *items):
        return {"created": created, "items": [{"field": f, "fromString": a, "toString": b} for f, a, b in items]}

    log = {
        "key": "KAFKA-1",
        "histories": [
            history("2024-10-15T10:30:00.000+0000", ("status", "Open", "In Progress")),
            history("2024-10-20T09:00:00.000+0000", ("assignee", None, "Ann")),
            history("2024-11-01T09:00:00.000+0000", ("status", "In Progress", "In Review")),
            history("2024-11-05T14:22:00.000+0000", ("status", "In Review", "Done"), ("resolution", None, "Fixed")),
        ],
    }
    return spark.createDataFrame([(json.dumps(log),)], "raw string")


def test_changelog_gives_three_status_and_one_assignee_event(spark):
    events = lc.import_changelog(changelog(spark), F.lit("S"))
    kinds = [r["event_type"] for r in events.collect()]
    assert sorted(kinds) == ["assignee_changed", "status_changed", "status_changed", "status_changed"]


def test_cycle_time_of_the_changelog(spark):
    events = lc.import_changelog(changelog(spark), F.lit("S"))
    tickets = spark.createDataFrame(
        [("S", "KAFKA-1", when("2024-10-01"), when("2024-11-06")), ("S", "KAFKA-2", when("2024-10-01"), None)],
        "case_study_id string, ticket_key string, created_at timestamp, resolved_at timestamp",
    )
    got = {r["ticket_key"]: (r["lead_time"], r["cycle_time"]) for r in lc.ticket_metrics(tickets, events).collect()}
    assert got == {"KAFKA-1": (36 * 86_400_000, 1_828_320_000), "KAFKA-2": (None, None)}


def test_events_of_another_study_leak_only_on_request(spark):
    tickets = spark.createDataFrame([("S", "K-1")], "case_study_id string, ticket_key string")
    events = spark.createDataFrame([("S", "K-1", 1), ("T", "K-1", 2)], "case_study_id string, ticket_key string, id long")
    assert lc.ticket_events(tickets, events).count() == 1
    assert lc.ticket_events(tickets, events, same_study=False).count() == 2


def test_commit_cap_counts_commits_not_events(spark):
    commits = spark.createDataFrame(
        [("a", "AB-1 AB-2", when("2024-01-03"), "S", "x"), ("b", "none", when("2024-01-04"), "S", "x"), ("c", "AB-1", when("2024-01-02"), "S", "x")],
        "sha string, message string, committed_at timestamp, case_study_id string, author_name string",
    )
    assert sorted(r["commit_sha"] for r in lc.import_commits(commits, max_commits=1).collect()) == ["a", "a"]
    assert lc.import_commits(commits, since=when("2024-01-03")).count() == 2


def test_usage_of_two_calls(spark):
    entries = spark.createDataFrame([(1, 10, "m", 100, 50), (2, 20, "m", 200, 100)], "seq long, ts_ms long, model_id string, prompt_tokens long, completion_tokens long")
    row = u.usage_by_model(entries).first()
    assert (row["calls"], row["total_tokens"], row["avg_tokens_per_call"], row["max_tokens_in_call"]) == (2, 450, 225.0, 300)
    overall = [r for r in u.usage_overall(entries).collect() if r["model_id"] is None]
    assert overall[0]["total_tokens"] == 450
    assert u.recent_usage(entries, 0).count() == 2 and u.recent_usage(entries, 1).first()["seq"] == 2


def test_model_lookup_order(spark):
    ids = ["gpt-4o-mini", "GPT-4-turbo-2024", "gpt-99", "claude-9", "gemini-x", "o1-next", "llama"]
    df = spark.createDataFrame([(i,) for i in ids], "model_id string")
    got = {r["model_id"]: (r["family"], r["vendor"], r["max_tokens"]) for r in u.resolve_model(df).collect()}
    assert got["gpt-4o-mini"] == ("GPT-4o", "OpenAI", 128000)
    assert got["GPT-4-turbo-2024"] == ("GPT-4 Turbo", "OpenAI", 128000)
    assert got["gpt-99"] == ("gpt-99", "OpenAI", 8192)
    assert got["claude-9"][1:] == ("Anthropic", 200000) and got["gemini-x"][1:] == ("Google", 32768)
    assert got["o1-next"][1:] == ("OpenAI", 128000) and got["llama"] == ("llama", "Unknown", 0)
