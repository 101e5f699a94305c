"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR   folder with the tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  names to run, separated by commas (default: the list below; "all")
"""

from __future__ import annotations

import json
import os
import time

from spanmill.plans.catalog import QUERIES
from spanmill.session import build_session, drop_written

HEADLINE = [
    "validate_spans",
    "insert_spans_first_wins",
    "scrub_pii",
    "pii_report",
    "compute_cost",
    "assemble_sse_openai",
    "calls_to_spans",
    "trace_rollup",
    "session_rollup",
    "summary_stats",
    "summary_stats_approx",
    "summary_by_trace",
    "hourly_volume",
    "model_usage",
    "top_agents",
    "recent_errors",
    "error_clusters",
    "error_significant_terms",
    "overview",
    "cost_summary",
    "search_spans",
    "list_traces",
    "trace_tree",
    "span_timeline",
    "compare_traces",
    "evaluate_alerts",
    "replay_alerts",
    "retention_report",
    "stream_ingest",
    "stream_trace_rollup",
    "stream_alert_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        "spanmill-bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the engine before the clock runs.
    QUERIES["compute_cost"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    drop_written(spark)
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        drop_written(spark)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
