"""What the plans must show: pruned and filtered scans, no cross joins."""

import pytest

from sparkgauge.plans.catalog import REGISTRY

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    return REGISTRY[name].run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_needed_columns(spark):
    text = plan(spark, "usage_by_model")
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string,text:string>" in text
    text = plan(spark, "query_by_tag")
    assert "props" not in text.split("ReadSchema", 1)[1]


def test_time_filter_reaches_the_scan(spark):
    text = plan(spark, "import_commits")
    assert "GreaterThanOrEqual(ts," in text and "LessThanOrEqual(ts," in text


@pytest.mark.parametrize("name", [n for n in REGISTRY if n not in ("usage_live", "console_stream_index", "content_stream_upsert")])
def test_no_nested_loop_or_cartesian_join(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
