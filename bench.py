"""Time the headline queries and print one JSON line.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

from sparkgauge.plans.catalog import REGISTRY
from sparkgauge.session import build_session

HEADLINE = [
    "delivery_metrics",
    "delivery_metrics_by_repo",
    "lead_time",
    "change_failure_rate",
    "recovery_time",
    "weekly_series",
    "filter_by_feature",
    "normalize_issue",
    "ticket_metrics",
    "ticket_timeline",
    "import_commits",
    "study_rollup",
    "console_summary",
    "error_categories",
    "assert_messages",
    "compare_checkpoints",
    "find_duplicates",
    "retention_cleanup",
    "snapshot_diff",
    "test_summary",
    "usage_overall",
    "best_match",
    "rank_matches",
    "keyword_best_candidate",
    "best_match_export",
    "training_examples",
    "eval_all",
    "prompt_accuracy",
    "mean_metric",
    "normalize_content",
    "html_nodes",
    "assert_exists_count",
    "page_text",
    "chunk_text",
    "make_rule",
    "scenarios_from_rules",
    "check_command",
    "validation_summary",
    "upsert_by_url",
    "usage_live",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # one small run first, so that no query pays for starting the engine
    REGISTRY["lead_time"].run(spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.time()
        REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    line = {"metric": "total_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}
    print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
