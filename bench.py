"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the cores; BENCH_QUERIES names other queries, comma separated, or "all".
Each query runs once to warm up and is then timed; results go to a no-op sink, so
every row and column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tidewatch.catalog import entries
from tidewatch.session import local_session

HEADLINE = [
    "realtime_dashboard", "rollup_hourly", "rollup_daily", "geography_churn", "demographics", "overall_kpis",
    "top_risk_customers", "risk_segments", "recent_predictions", "high_risk_alerts", "prediction_summary",
    "missing_profile", "numeric_column_stats", "duplicate_count",
    "fill_mean", "fill_median", "missing_policy_spark", "missing_policy_pandas", "iqr_bounds", "outlier_remove",
    "bin_named_ranges", "index_by_frequency", "one_hot_columns", "scale_minmax", "split_random", "split_stratified",
    "check_ranges", "drift_ks", "validation_report", "insert_if_absent", "upsert",
    "classification_metrics", "roc_auc", "event_defaults", "score_event_row",
    "feature_plan_one_hot", "feature_plan_indexed", "stream_score", "stream_rollup_hourly",
]


def run(spark, query, folder: str) -> float:
    started = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    known = entries()
    names = list(known) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = local_session(cpus, "bench")
    times = {}
    for name in names:
        run(spark, known[name].run, folder)
        times[name] = round(run(spark, known[name].run, folder), 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    result = {
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
