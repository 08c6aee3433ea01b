"""Query registry: one Spark plan and, where SQL can say it, one oracle text per name."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sparkgauge.plans.views import BASE_TABLES, VIEWS
from sparkgauge.session import configure
from sparkgauge.sources.tables import TEXT_TABLES, read_table, spread

# Spellings that differ between the two SQL dialects.
SPARK_WORDS = {"@ARR(": "array(", "@MS(": "unix_millis(", "@TSMS(": "timestamp_millis("}
ORACLE_WORDS = {"@ARR(": "list_value(", "@MS(": "epoch_ms(", "@TSMS(": "make_timestamp_ms("}


def _words_in(text: str) -> set[str]:
    return set(re.findall(r"[a-z_0-9]+", text))


def _views_for(text: str) -> list[str]:
    """Views named in ``text`` and the views those need, in declaration order."""
    needed: set[str] = set()
    todo = [text]
    while todo:
        for name in (_words_in(todo.pop()) & VIEWS.keys()) - needed:
            needed.add(name)
            todo.append(VIEWS[name])
    return [name for name in VIEWS if name in needed]


def with_views(body: str) -> str:
    """Prefix ``body`` with the WITH entries it needs."""
    names = _views_for(body)
    if not names:
        return body.strip()
    entries = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    body = body.strip()
    joiner = ",\n" + body[5:] if body.upper().startswith("WITH ") else "\n" + body
    return f"WITH {entries}{joiner}"


def _translate(text: str, words: dict[str, str]) -> str:
    for token, spelling in words.items():
        text = text.replace(token, spelling)
    return text


def _floor_ms(text: str) -> str:
    """DuckDB's epoch_ms rounds microseconds; Spark's unix_millis floors. Write the floor out."""
    word = "epoch_ms("
    while word in text:
        start = text.index(word)
        end, depth = start + len(word), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        inner = text[start + len(word) : end - 1]
        text = f"{text[:start]}(epoch_us({inner}) // 1000){text[end:]}"
    return text


class Tables:
    """The given tables of one folder and the domain views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        df = read_table(self.spark, self.folder, name)
        return spread(df) if name in TEXT_TABLES else df

    def view(self, name: str) -> DataFrame:
        text = _translate(with_views(f"SELECT * FROM {name}"), SPARK_WORDS)
        used = {b: self.table(b) for b in BASE_TABLES if f"{{{b}}}" in text}
        return self.spark.sql(text, **used)

    def __getattr__(self, name: str) -> DataFrame:
        if f"v_{name}" in VIEWS:
            return self.view(f"v_{name}")
        if name in BASE_TABLES:
            return self.table(name)
        raise AttributeError(name)


@dataclass(frozen=True)
class Query:
    name: str
    plan: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.plan(Tables(spark, folder))

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        text = _floor_ms(_translate(with_views(self.sql), ORACLE_WORDS))
        for b in BASE_TABLES:
            text = text.replace(f"{{{b}}}", b)
        return text


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def keep(plan: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, plan, sql)
        return plan

    return keep
