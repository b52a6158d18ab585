"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

    BENCH_QUERIES=a,b,c   run these instead
    BENCH_ALL=1           run every registered query
"""

from __future__ import annotations

import json
import os
import sys
import time

from callstrata.plans import catalog
from callstrata.session import build_session

HEADLINE = [
    # audit
    "audit_summary", "temporal_profile", "value_counts", "completeness", "daily_volume_stats", "seasonal_profile", "field_autodetect",
    # segmentation
    "segment_rules", "segment_summary", "daily_calls", "calendar_complete", "segmentation_totals", "daily_prophet",
    # holidays, roles, users
    "day_type_counts", "role_attendance", "holiday_metrics", "calls_by_user", "role_attach",
    # features and dashboard
    "feature_matrix", "heat_day_hour", "stability_metrics", "sliding_rate", "activity_sessions", "content_scan", "sanitize_text",
    # forecast
    "baseline_forecast", "forecast_table", "demand_alerts", "performance_score", "train_ridge", "fit_ar", "fit_trend_season", "temporal_cv",
    "forecast_ensemble",
]

#: Heavier queries, timed beside the headline and not in its total.
FURTHER = ["train_rf", "train_gbt", "random_search", "forecast_ensemble_trees", "full_run"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = HEADLINE + FURTHER
    if os.environ.get("BENCH_QUERIES"):
        names = os.environ["BENCH_QUERIES"].split(",")
    elif os.environ.get("BENCH_ALL"):
        names = list(catalog.QUERIES)
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()  # start the JVM and the code generator

    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        try:
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        except Exception as e:
            print(f"{name}: {str(e)[:300]}", file=sys.stderr)
            times[name] = -1.0
    further = {n: times.pop(n) for n in FURTHER if n in times and names == HEADLINE + FURTHER}
    total = round(sum(t for t in times.values() if t > 0), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "further": further,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
