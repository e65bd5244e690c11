"""Command line entry: the analysis stages as Spark jobs.

    spark-submit -m farewise.cli ingest   --csv 'data/raw/*.csv' --out data/processed/taxi_parquet
    python -m farewise.cli check          --trips data/processed/taxi_parquet
    python -m farewise.cli reports        --trips data/processed/taxi_parquet --out outputs
    python -m farewise.cli ml-prepare     --trips data/processed/taxi_parquet --out data/processed/ml_fare_dataset
    python -m farewise.cli ml-train       --dataset data/processed/ml_fare_dataset --out outputs
    python -m farewise.cli residual-report --residuals outputs/residuals --out outputs

The session comes from ``SparkSession.builder.getOrCreate()`` so cluster
settings (master, memory, shuffle partitions, checkpoint folder) apply.
"""

from __future__ import annotations

import argparse
import json
import os
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from farewise.config import DEFAULT, MIN_GROUP_TRIPS, SEED, TOP_N_CATEGORIES
from farewise.session import ensure_checkpoint_dir, scratch_scope

MONEY = {
    "hourly_demand_revenue": ("total_revenue_usd",),
    "payment_split": ("revenue_usd",),
}


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("farewise").getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def cmd_ingest(spark, args) -> None:
    from pyspark.sql import types as T

    from farewise.config import trip_schema
    from farewise.sources.csv import ingest_csv_observed, read_ingested, reject_counts

    schema = trip_schema(timestamp_type=T.TimestampType() if args.timestamps == "zoned" else None)
    report = ingest_csv_observed(spark, args.csv, args.out, schema, check_header=args.check_header,
                                 time_zone=args.time_zone)
    print(json.dumps(report))
    if args.reasons:
        rejects = read_ingested(spark, args.out, rejected=True)
        print(json.dumps({r["reason"]: r["lines"] for r in reject_counts(rejects, schema, args.time_zone).collect()}))
    read_ingested(spark, args.out).printSchema()


def cmd_check(spark, args) -> None:
    from farewise.operators import preview, profile_shape
    from farewise.sources.csv import REJECT_FLAG
    from farewise.sources.parquet import read_trips_parquet

    df = read_trips_parquet(spark, args.trips)
    if REJECT_FLAG in df.columns:
        df = df.filter(~F.col(REJECT_FLAG)).drop(REJECT_FLAG)
    print(json.dumps(profile_shape(df).first().asDict()))
    df.printSchema()
    preview(df, ["tpep_pickup_datetime", "trip_distance", "total_amount"], 5,
            ["tpep_pickup_datetime", "trip_distance", "total_amount"]).show(truncate=False)


def _trips(spark, path):
    from farewise.sources.csv import REJECT_FLAG
    from farewise.sources.parquet import read_trips_parquet

    df = read_trips_parquet(spark, path)
    return df.filter(~F.col(REJECT_FLAG)).drop(REJECT_FLAG) if REJECT_FLAG in df.columns else df


def cmd_reports(spark, args) -> None:
    from farewise.plans.runner import run_reports
    from farewise.sources.report import write_report_csv

    cfg = replace(DEFAULT, percentile_method=args.percentiles, percentile_accuracy=args.accuracy, kll_k=args.kll_k)

    def sink(name, df):
        return write_report_csv(df, os.path.join(args.out, name), MONEY.get(name, ()))

    written = run_reports(_trips(spark, args.trips), cfg, args.only or None, args.min_trips, sink)
    print(json.dumps(written))


def cmd_ml_prepare(spark, args) -> None:
    from farewise.plans.modelling import ml_fare_dataset
    from farewise.sources.parquet import write_parquet

    ds = ml_fare_dataset(_trips(spark, args.trips), top_n=args.top_n, key=args.key)
    write_parquet(ds, args.out, num_partitions=args.partitions)
    print(json.dumps({"rows": spark.read.parquet(args.out).count(), "path": args.out}))


def cmd_ml_train(spark, args) -> None:
    from farewise.plans import modelling as ml
    from farewise.sources.parquet import write_parquet
    from farewise.sources.report import write_report_csv

    ds = spark.read.parquet(args.dataset)
    params = {"num_trees": args.trees, "min_instances": args.min_leaf, "max_bins": args.max_bins,
              "max_train_rows": args.max_train_rows}
    _, test = ml.train_and_evaluate(ds, args.key, args.sample_fraction, with_forest=True, forest_params=params,
                                    seed=args.seed)
    models = {name: pred for pred, name in ml.METRIC_NAMES.items()}
    write_report_csv(ml.model_metrics(test, models, args.sample_fraction), os.path.join(args.out, "ml_metrics"))
    res = ml.residual_table(test, {ml.ERR0: ml.PRED0, ml.ERR1: ml.PRED1}, key=args.key)
    write_parquet(res, os.path.join(args.out, "residuals"))


def cmd_residual_report(spark, args) -> None:
    from farewise.plans import modelling as ml
    from farewise.sources.report import write_report_csv

    res = spark.read.parquet(args.residuals)
    for name, report in ml.residual_reports(res, ml.REPORT_NAMES).items():
        write_report_csv(report, os.path.join(args.out, f"residuals_{name}"))


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="farewise")
    sub = ap.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("ingest")
    p.add_argument("--csv", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--check-header", action="store_true", help="fail on a file whose header differs from the schema")
    p.add_argument("--timestamps", choices=["wall", "zoned"], default="wall", help="TIMESTAMP_NTZ or TIMESTAMP columns")
    p.add_argument("--time-zone", default=None, help="zone of TIMESTAMP cells (default: the session's)")
    p.add_argument("--reasons", action="store_true", help="print the number of rejected lines per reason")
    p = sub.add_parser("check")
    p.add_argument("--trips", required=True)
    p = sub.add_parser("reports")
    p.add_argument("--trips", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--only", nargs="*")
    p.add_argument("--min-trips", type=int, default=MIN_GROUP_TRIPS)
    p.add_argument("--percentiles", choices=["digits", "bracket", "kll", "sketch", "exact"], default=DEFAULT.percentile_method)
    p.add_argument("--accuracy", type=int, default=DEFAULT.percentile_accuracy, help="percentile_approx accuracy")
    p.add_argument("--kll-k", type=int, default=DEFAULT.kll_k, help="KLL sketch size (8..65535)")
    p = sub.add_parser("ml-prepare")
    p.add_argument("--trips", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--top-n", type=int, default=TOP_N_CATEGORIES)
    p.add_argument("--key", default=None)
    p.add_argument("--partitions", type=int, default=None)
    p = sub.add_parser("ml-train")
    p.add_argument("--dataset", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--key", default=None)
    p.add_argument("--sample-fraction", type=float, default=1.0)
    p.add_argument("--trees", type=int, default=200)
    p.add_argument("--min-leaf", type=int, default=5)
    p.add_argument("--max-bins", type=int, default=256)
    p.add_argument("--max-train-rows", type=int, default=None, help="learn the forest from a hash sample of about so many rows (default: all)")
    p.add_argument("--seed", type=int, default=SEED)
    p = sub.add_parser("residual-report")
    p.add_argument("--residuals", required=True)
    p.add_argument("--out", required=True)
    args = ap.parse_args(argv)
    spark = _session()
    command = {"ingest": cmd_ingest, "check": cmd_check, "reports": cmd_reports, "ml-prepare": cmd_ml_prepare,
               "ml-train": cmd_ml_train, "residual-report": cmd_residual_report}[args.cmd]
    with scratch_scope(spark):  # a stage leaves nothing but its outputs
        command(spark, args)


if __name__ == "__main__":
    main()
