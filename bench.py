"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tapeloom.plans import outcome_queries
from tapeloom.plans import registry

HEADLINE = ("b1_time_bars", "v4_atr", "v6_regime", "f1_cvd", "f3_flow_window", "p3_point_of_control", "p12_session_vwap", "s5_sweep_outcomes", "q9_barrier_race", "o12_upper_first_by_regime", "ev14_fingerprint", "d3_oi_grid")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
    spark = builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.log.level", "ERROR").getOrCreate()
    queries, took = registry.queries(), {}
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    began = time.perf_counter()
    outcome_queries.outcome_tables(spark, sf_dir)  # the shared tables that outcome queries read, written once per session
    tables = round(time.perf_counter() - began, 3)
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    total = round(sum(took.values()) + tables, 3)
    rate = round(events * len(took) / total / int(cpus), 1)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1], "shared_tables_sec": tables, "events": events, "events_per_sec_per_core": rate}))
    spark.stop()


if __name__ == "__main__":
    main()
