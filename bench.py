"""Time the headline queries; prints one JSON line.

The nested event table is shaped and written before the clock starts ("fixture_sec"); every query
then runs its whole chain from that table, or from the given tables, with nothing kept in between.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from workloads.adapter import nested_events  # noqa: E402
from workloads.queries import QUERIES  # noqa: E402

HEADLINES = (
    "dataset_overview",
    "event_name_profile",
    "parameter_profile",
    "purchase_quality",
    "duplicate_transaction_patterns",
    "final_key_profile",
    "stage_events",
    "stage_items",
    "fct_transactions",
    "fct_sessions",
    "bridge_touchpoints",
    "channel_comparison",
    "channel_shift",
    "geo_profile",
    "geo_weekly_outcomes",
    "region_features",
    "pair_metrics",
    "candidate_edges",
    "reconcile_sessions",
    "dim_pseudo_users",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINES
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("journeyloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    start = time.perf_counter()
    nested_events(spark, sf_dir).count()
    fixture = time.perf_counter() - start
    seconds: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "fixture_sec": round(fixture, 3),
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
