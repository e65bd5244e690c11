"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is timed end to end (plan + run); small reports are collected,
row-level outputs are run into the ``noop`` sink so nothing large reaches
the driver. ``all_reports_shared`` runs the ten reports through the runner
(two scans in all). The test-data trips are materialised once as
Parquet (timed separately as ``trips_materialize``, not in the total), which
is the processed table every report reads in production.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEAT = int(os.environ.get("BENCH_REPEAT", "2"))

HEADLINE = [
    "hourly_demand_revenue", "weekend_vs_weekday_hourly", "payment_split", "top_pickup_grids",
    "regime_baseline", "regime_deviation_summary", "deviation_by_time", "deviation_top_grids",
    "decomposition_by_time", "toll_heavy_grids", "group_percentiles", "csv_ingest", "ml_fare_dataset",
    "linear_metrics", "model_metrics",
]
ROW_LEVEL = {"csv_ingest", "ml_fare_dataset"}


def _sf_value(path: str):
    base = os.path.basename(os.path.normpath(path))
    try:
        return float(base[2:]) if base.startswith("sf") else base
    except ValueError:
        return base


def main() -> None:
    from farewise.plans import catalog
    from farewise.plans.runner import run_reports
    from farewise.session import local_session
    from farewise.sources import trips_table

    spark = local_session(CPUS, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "8")))

    def run(name: str) -> None:
        df = catalog.QUERIES[name](spark, SF_DIR)
        if name in ROW_LEVEL:
            df.write.format("noop").mode("overwrite").save()
        else:
            df.collect()

    t0 = time.perf_counter()
    trips_table(spark, SF_DIR)
    materialize = round(time.perf_counter() - t0, 3)
    run("regime_baseline")  # warm-up: JVM, code generation, file listing
    times: dict[str, float] = {}
    for name in HEADLINE:
        best = None
        for _ in range(REPEAT):
            t0 = time.perf_counter()
            run(name)
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    best = None
    for _ in range(REPEAT):
        t0 = time.perf_counter()
        run_reports(trips_table(spark, SF_DIR), min_trips=catalog.MIN_TRIPS_TEST)
        dt = time.perf_counter() - t0
        best = dt if best is None else min(best, dt)
    times["all_reports_shared"] = round(best, 3)
    total = round(sum(v for k, v in times.items() if k != "all_reports_shared"), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
                      "sf": _sf_value(SF_DIR), "cpus": CPUS, "trips_materialize": materialize}))
    spark.stop()


if __name__ == "__main__":
    main()
