"""Every registered query against its oracle text on the smallest tables."""

import duckdb
import pytest

import check
from sparkgauge.plans.catalog import REGISTRY
from sparkgauge.sources.tables import SCHEMAS

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, oracle, name):
    query = REGISTRY[name]
    df = query.run(spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    if query.sql is None:
        assert got
        return
    want = oracle.execute(query.oracle())
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert check.rows_of(df.columns, got) == check.rows_of(columns, want.fetchall())


def test_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
