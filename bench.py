"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of parquet files, BENCH_CPUS the local cores,
BENCH_QUERIES (optional) a comma-separated choice of queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from weekwise.plans.registry import QUERIES  # noqa: E402
from weekwise.session import build  # noqa: E402

HEADLINE = [
    "weekly_overage",
    "relay_store_join",
    "master_schedule",
    "dedupe_instances",
    "overactive_groups",
    "master_status",
    "exec_summary",
    "store_performance",
    "department_breakdown",
    "store_month_cost",
    "risk_histogram",
    "kpi_metrics",
    "top_risk",
    "merchant_scorecard",
    "dq_completeness",
    "dq_orphans",
    "group_sync_violations",
    "assignment_violations",
    "key_suffix",
    "before_after",
    "cost_roi_quadrants",
    "hours_heatmap",
    "move_candidates",
    "rebalance",
    "weekly_hours_compare",
    "stream_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build("weekwise-bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
