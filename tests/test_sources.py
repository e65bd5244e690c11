"""CSV ingest with rejects (batch and streaming), Parquet and report round trips."""

import os
import tempfile

import pytest
from pyspark.sql import types as T

from farewise.config import trip_schema
from farewise.session import materialize, path_exists, scratch_path, scratch_scope
from farewise.sources.csv import (
    file_headers, ingest_counts, ingest_csv, ingest_csv_observed, read_ingested, read_trips_csv, reject_counts,
    reject_reasons,
)
from farewise.sources.parquet import read_trips_parquet, write_parquet
from farewise.sources.report import read_report_csv, write_report_csv
from farewise.streaming.ingest import run_ingest

SCHEMA = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DoubleType()),
                       T.StructField("t", T.TimestampNTZType())])
# hand-made malformed file: 2 good lines, 3 bad (bad int, too few fields, bad double)
LINES = ["a,b,t", "1,2.5,2015-01-01 10:00:00", "x,3.5,2015-01-01 11:00:00", "3,4.5,2015-01-01 12:00:00", "4,1",
         "5,bad,2015-01-01 12:00:00"]


@pytest.fixture()
def csv_dir():
    d = tempfile.mkdtemp(prefix="farewise-csv-")
    with open(os.path.join(d, "part-0.csv"), "w") as fh:
        fh.write("\n".join(LINES) + "\n")
    return d


def _scratch():
    return tempfile.mkdtemp(prefix="farewise-out-")


def test_ingest_keeps_two_rejects_three(spark, csv_dir):
    out = ingest_csv(spark, csv_dir, os.path.join(_scratch(), "ing"), SCHEMA)
    counts = ingest_counts(spark, out).first()
    assert (counts.kept, counts.rejected) == (2, 3)
    kept = read_ingested(spark, out)
    assert sorted(r.a for r in kept.collect()) == [1, 3]
    # the answer does not depend on which columns are read afterwards
    assert read_ingested(spark, out).select("a").count() == 2
    assert read_ingested(spark, out, rejected=True).count() == 3


def test_lazy_drop_reads_every_column(spark, csv_dir):
    df = read_trips_csv(spark, csv_dir, SCHEMA)
    assert sorted(r.a for r in df.collect()) == [1, 3]


def test_failfast_raises(spark, csv_dir):
    with pytest.raises(Exception):
        read_trips_csv(spark, csv_dir, SCHEMA, on_bad="fail").collect()


def test_streaming_ingest_is_incremental(spark, csv_dir):
    base = _scratch()
    out, ckpt = os.path.join(base, "out"), os.path.join(base, "ckpt")
    run_ingest(spark, csv_dir, out, ckpt, SCHEMA)
    assert read_ingested(spark, out).count() == 2
    with open(os.path.join(csv_dir, "part-1.csv"), "w") as fh:
        fh.write("a,b,t\n7,1.5,2015-01-02 10:00:00\n")
    run_ingest(spark, csv_dir, out, ckpt, SCHEMA)  # only the new file is read
    counts = ingest_counts(spark, out).first()
    assert (counts.kept, counts.rejected) == (3, 3)


def test_parquet_and_report_round_trip(spark):
    df = spark.createDataFrame([("x", 1, 2.5), ("y", 2, 1.148472926e7)], "k string, n long, v double")
    p = write_parquet(df, os.path.join(_scratch(), "pq"), num_partitions=2)
    assert sorted(read_trips_parquet(spark, p).collect()) == sorted(df.collect())
    r = write_report_csv(df.orderBy("k"), os.path.join(_scratch(), "rep"))
    files = [f for f in os.listdir(r) if f.endswith(".csv")]
    assert len(files) == 1
    assert read_report_csv(spark, r, df.schema).collect() == df.orderBy("k").collect()
    money = write_report_csv(df.orderBy("k"), os.path.join(_scratch(), "money"), money_cols=("v",))
    text = open(os.path.join(money, [f for f in os.listdir(money) if f.endswith(".csv")][0])).read()
    assert "11484729.26" in text and "E7" not in text


def _write(lines, name="part-0.csv", into=None):
    d = into or tempfile.mkdtemp(prefix="farewise-csv-")
    with open(os.path.join(d, name), "w") as fh:
        fh.write("\n".join(lines) + "\n")
    return d


def _jobs(spark, run):
    """Number of Spark jobs that ``run`` starts."""
    sc = spark.sparkContext
    group = f"jobs-{os.urandom(4).hex()}"
    sc.setJobGroup(group, "counted")
    try:
        result = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return result, len(sc.statusTracker().getJobIdsForGroup(group))


def test_ingest_report_comes_from_the_writing_job(spark):
    schema = T.StructType([T.StructField("trip_distance", T.DoubleType()), T.StructField("passenger_count", T.IntegerType())])
    d = _write(["trip_distance,passenger_count", "-1.0,1", "2.0,-3", "-4.0,x", ",", "5.0,2"])
    out = os.path.join(_scratch(), "ing")
    seen, jobs = _jobs(spark, lambda: ingest_csv_observed(spark, d, out, schema))
    assert jobs == 1
    # the rejected line's negative distance is no violation of a kept row; total_amount is absent
    assert seen == {"kept": 4, "rejected": 1, "rows": 4, "negative_trip_distance": 1, "negative_passenger_count": 1, "columns": 2}
    assert ingest_counts(spark, out).first().asDict() == {"kept": 4, "rejected": 1}
    empty = ingest_csv_observed(spark, _write(["trip_distance,passenger_count"]), os.path.join(_scratch(), "ing"), schema)
    assert (empty["kept"], empty["rejected"], empty["negative_trip_distance"]) == (0, 0, 0)


def test_reject_reasons_name_the_cells(spark):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("s", T.StringType()),
                           T.StructField("b", T.DoubleType()), T.StructField("t", T.TimestampNTZType())])
    d = _write(["a,s,b,t", "1,ok,2.5,2015-01-01 10:00:00",
                'x,"comma, inside",2.5,2015-01-01 10:00:00',       # quoted comma: one cell
                "y,z,bad,never",                                   # three cells at once
                " 4,blank,1.0,2015-01-01 10:00:00",                # the scan's parser takes no blanks in integers
                "5,short", "6,long,1.5,2015-01-01 10:00:00,extra",
                "7,,,", "1.5,frac,,2015-01-01 10:00:00"])
    out = ingest_csv(spark, d, os.path.join(_scratch(), "ing"), schema)
    rejects = read_ingested(spark, out, rejected=True)
    got = {r["s"]: r["reject_reasons"] for r in reject_reasons(rejects, schema).collect()}
    assert got == {"comma, inside": ["a"], "z": ["a", "b", "t"], "blank": ["a"], "short": ["field_count"],
                   "long": ["field_count"], "frac": ["a"]}
    assert {r["reason"]: r["lines"] for r in reject_counts(rejects, schema).collect()} == {
        "a": 4, "b": 1, "t": 1, "field_count": 2}
    assert reject_reasons(rejects.limit(0), schema).count() == 0


def test_headers_are_compared_with_the_positional_schema(spark):
    d = _write(["a,b,t", "1,2.5,2015-01-01 10:00:00"])
    _write([' A ,"b",T', "2,2.5,2015-01-01 10:00:00"], "part-1.csv", d)
    _write(["b,a,t", "3,2.5,2015-01-01 10:00:00"], "part-2.csv", d)
    _write(["a,b", "4,2.5"], "part-3.csv", d)
    _write(["a,b,t,u"], "part-4.csv", d)
    got = {r["file"].rsplit("/", 1)[1]: (r["matches"], r["first_difference"])
           for r in file_headers(spark, d, SCHEMA).collect()}
    assert got == {"part-0.csv": (True, None), "part-1.csv": (True, None), "part-2.csv": (False, 1),
                   "part-3.csv": (False, 3), "part-4.csv": (False, 4)}
    with pytest.raises(Exception, match="header"):
        ingest_csv(spark, d, os.path.join(_scratch(), "ing"), SCHEMA, check_header=True)
    good = _write(["a,b,t", "1,2.5,2015-01-01 10:00:00", "x,1,2015-01-01 10:00:00"])
    out = ingest_csv(spark, good, os.path.join(_scratch(), "ing"), SCHEMA, check_header=True)
    assert ingest_counts(spark, out).first().asDict() == {"kept": 1, "rejected": 1}


def test_zoned_timestamps_take_the_session_or_the_stated_zone(spark):
    schema = T.StructType([T.StructField("t", T.TimestampType())])
    d = _write(["t", "2015-07-01 10:00:00"])

    def hour_utc(**zone):
        out = ingest_csv(spark, d, os.path.join(_scratch(), "ing"), schema, **zone)
        return read_ingested(spark, out).selectExpr("unix_seconds(t) % 86400 / 3600 AS h").first()["h"]

    assert hour_utc() == 10 and hour_utc(time_zone="America/New_York") == 14
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert hour_utc() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    zoned = trip_schema(timestamp_type=T.TimestampType())
    assert zoned["tpep_pickup_datetime"].dataType == T.TimestampType()


def test_scratch_scope_removes_what_it_made(spark):
    outside = scratch_path(spark, "outside")
    spark.range(3).write.parquet(outside)
    with scratch_scope(spark) as outer:
        kept = materialize(spark.range(5), "kept")
        with pytest.raises(ZeroDivisionError), scratch_scope(spark) as inner:
            materialize(spark.range(7), "failed")
            1 / 0
        assert inner and not path_exists(spark, inner[0])
        assert len(outer) == 1 and path_exists(spark, outer[0]) and kept.count() == 5
    assert not path_exists(spark, outer[0])
    assert spark.read.parquet(outside).count() == 3 and outside not in outer
