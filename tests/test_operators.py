"""Edge rows for each operator (nulls, NaN, boundaries, ties, empty input)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farewise.config import PAYMENT_LABELS, REGIME_EDGES, REGIME_LABELS, TRIP_SCHEMA
from farewise.functions import (
    bucketize, decode, duration_minutes, is_weekend, pickup_hour, sum_components, unit_rate,
)
from farewise.operators import (
    clean, drop_incomplete, keep_top_n, percentiles, preview, profile_shape, rate_guard, top_k, top_keys,
    violation_counts, within_bbox,
)
from farewise.plans import reports


def _one_col(spark, values, dtype=T.DoubleType(), name="x"):
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField(name, dtype, True)])
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], schema)


def _by_i(df, col):
    return [r[col] for r in df.orderBy("i").collect()]


def test_bucketize_right_closed_with_null_and_nan(spark):
    df = _one_col(spark, [0.01, 1.0, 1.0001, 5.0, 5.0001, None, float("nan")])
    out = df.select("i", bucketize("x", REGIME_EDGES, REGIME_LABELS).alias("r"))
    assert _by_i(out, "r") == ["short", "short", "medium", "medium", "long", "long", "long"]


def test_bucketize_rejects_label_mismatch():
    with pytest.raises(ValueError):
        bucketize("x", [1.0], ["a"])


def test_unit_rate_and_guard(spark):
    schema = "i int, fare double, dist double"
    df = spark.createDataFrame([(0, 5.0, 0.0), (1, 5.0, None), (2, 50.0, 1.0), (3, 0.0, 2.0), (4, 51.0, 1.0),
                                (5, 10.0, -1.0)], schema)
    rated = df.withColumn("fare_per_mile", unit_rate("fare", "dist"))
    assert _by_i(rated, "fare_per_mile") == [None, None, 50.0, 0.0, 51.0, -10.0]
    kept = sorted(r.i for r in rate_guard(rated).collect())
    assert kept == [2, 3]  # exactly 50 and a zero fare are inside the inclusive guard


def test_duration_minutes_edges(spark):
    t0 = dt.datetime(2024, 1, 5, 23, 30, 0)
    rows = [(0, t0, t0), (1, t0, t0 - dt.timedelta(minutes=5)), (2, t0, t0 + dt.timedelta(minutes=180)),
            (3, t0, t0 + dt.timedelta(minutes=45)), (4, None, t0)]
    df = spark.createDataFrame(rows, "i int, s timestamp_ntz, e timestamp_ntz")
    out = df.select("i", duration_minutes("s", "e").alias("m"))
    assert _by_i(out, "m") == [0.0, -5.0, 180.0, 45.0, None]


def _trips(spark, rows):
    """Trips with defaults; ``rows`` are dicts overriding columns."""
    base = {
        "VendorID": 1, "tpep_pickup_datetime": dt.datetime(2024, 1, 2, 10, 0, 0),
        "tpep_dropoff_datetime": dt.datetime(2024, 1, 2, 10, 20, 0), "passenger_count": 1, "trip_distance": 2.0,
        "pickup_longitude": -73.95, "pickup_latitude": 40.75, "RateCodeID": 1, "store_and_fwd_flag": "N",
        "dropoff_longitude": -73.9, "dropoff_latitude": 40.7, "payment_type": 1, "fare_amount": 10.0,
        "extra": 0.5, "mta_tax": 0.5, "tip_amount": 1.0, "tolls_amount": 0.0, "improvement_surcharge": 0.3,
        "total_amount": 12.3,
    }
    data = []
    for r in rows:
        d = dict(base)
        d.update(r)
        data.append(tuple(d[f.name] for f in TRIP_SCHEMA.fields))
    return spark.createDataFrame(data, TRIP_SCHEMA)


def test_profile_duration_bounds_differ(spark):
    p = dt.datetime(2024, 1, 2, 10, 0, 0)
    rows = [{"tpep_dropoff_datetime": p + dt.timedelta(minutes=m)} for m in (0, 1, 179, 180, 181)]
    trips = _trips(spark, rows)
    assert clean(trips, "analytics").count() == 2      # 0 < minutes < 180
    assert clean(trips, "modelling").count() == 3      # 0 < minutes <= 180


def test_profiles_zero_and_negative_values(spark):
    trips = _trips(spark, [{"trip_distance": 0.0}, {"fare_amount": 0.0}, {"total_amount": -1.0},
                           {"trip_distance": None}, {}])
    assert clean(trips, "analytics").count() == 3      # distance >= 0 keeps 0.0; total < 0 and null dropped
    assert clean(trips, "baseline").count() == 3       # distance > 0, fare >= 0 (total not checked)
    assert clean(trips, "deviation").count() == 2      # fare > 0 too


def test_within_bbox_edges(spark):
    rows = [{"pickup_latitude": 40.5, "pickup_longitude": -74.5}, {"pickup_latitude": 41.0, "pickup_longitude": -73.5},
            {"pickup_latitude": 0.0, "pickup_longitude": 0.0}, {"pickup_latitude": None},
            {"pickup_latitude": 41.0000001}]
    assert within_bbox(_trips(spark, rows)).count() == 2


def test_calendar_week_boundaries(spark):
    ts = [dt.datetime(2024, 1, 5, 23, 59, 59), dt.datetime(2024, 1, 6, 0, 0, 0), dt.datetime(2024, 1, 7, 23, 59, 59),
          dt.datetime(2024, 1, 8, 0, 0, 0), None]
    df = _one_col(spark, ts, T.TimestampNTZType(), "ts")
    out = df.select("i", pickup_hour("ts").alias("h"), is_weekend("ts").alias("w"))
    assert _by_i(out, "h") == [23, 0, 23, 0, None]
    assert _by_i(out, "w") == [False, True, True, False, None]


def test_decode_codes_unknown_and_null(spark):
    df = _one_col(spark, [1, 2, 3, 4, 5, 6, 7, None], T.IntegerType())
    out = df.select("i", decode("x", PAYMENT_LABELS, "Other").alias("l"))
    assert _by_i(out, "l") == ["Credit Card", "Cash", "No Charge", "Dispute", "Unknown", "Voided", "Other", "Other"]


def test_sum_components_nulls(spark):
    df = spark.createDataFrame([(0, None, None, None), (1, 0.5, None, 0.3)], "i int, a double, b double, c double")
    out = df.select("i", sum_components(["a", "b", "c"]).alias("s"))
    assert _by_i(out, "s") == [0.0, 0.8]


def _disc(values, p):
    vals = sorted(v for v in values if v is not None)
    if not vals:
        return None
    k = max(1, math.ceil(p * len(vals)))
    return vals[k - 1]


def test_percentiles_small_groups(spark):
    groups = {"one": [3.0], "two": [2.0, 1.0], "even": [4.0, 1.0, 3.0, 2.0], "odd": [5.0, 1.0, 4.0, 2.0, 3.0],
              "same": [7.0, 7.0, 7.0], "nulls": [None, None]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    levels = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    out = {r.g: r for r in percentiles(df, ["g"], "v", levels, count_as="n").collect()}
    for g, vs in groups.items():
        for name, p in levels.items():
            assert out[g][name] == _disc(vs, p), (g, name)
        assert out[g]["n"] == len(vs)


def test_top_k_ties_are_broken_by_key(spark):
    df = spark.createDataFrame([("b", 5), ("a", 5), ("c", 5), ("d", 9), (None, 5)], "k string, n long")
    got = [r.k for r in top_k(df, [F.desc("n")], 3, ["k"]).collect()]
    assert got == ["d", None, "a"]
    assert top_k(df, [F.desc("n")], 50, ["k"]).count() == 5


def test_keep_top_n_ties_and_null(spark):
    keys = ["a"] * 3 + ["b"] * 2 + ["c"] * 2 + [None] * 5
    df = _one_col(spark, keys, T.StringType(), "k")
    out = keep_top_n(df, "k", 2, "top")
    got = {(r.k, r.top) for r in out.collect()}
    assert got == {("a", "a"), ("b", "b"), ("c", "other"), (None, "other")}
    assert out.count() == len(keys)
    # n larger than the number of keys keeps every key
    assert {r.top for r in keep_top_n(df, "k", 10, "top").collect()} == {"a", "b", "c", "other"}


def test_drop_incomplete_null_and_nan(spark):
    df = spark.createDataFrame([(0, 1.0), (1, None), (2, float("nan"))], "i int, x double")
    assert [r.i for r in drop_incomplete(df).collect()] == [0]


def test_violation_counts_skip_absent_columns(spark):
    trips = _trips(spark, [{"trip_distance": -1.0}, {"passenger_count": -1}, {"total_amount": None}, {}])
    row = violation_counts(trips).first()
    assert (row.rows, row.negative_trip_distance, row.negative_total_amount, row.negative_passenger_count) == \
        (4, 1, 0, 1)
    only = violation_counts(trips.select("trip_distance")).first()
    assert only.asDict() == {"rows": 4, "negative_trip_distance": 1}


def test_profile_shape_and_preview(spark):
    trips = _trips(spark, [{"trip_distance": float(i)} for i in range(7)])
    shape = profile_shape(trips).first()
    assert (shape.rows, shape.columns) == (7, 19)
    head = preview(trips, ["trip_distance"], 3, ["trip_distance"]).collect()
    assert [r.trip_distance for r in head] == [0.0, 1.0, 2.0]


@pytest.mark.parametrize("report", [
    reports.hourly_demand_revenue, reports.weekend_vs_weekday_hourly, reports.payment_split,
    reports.top_pickup_grids, reports.regime_baseline, reports.regime_deviation_summary,
    reports.deviation_by_time, reports.deviation_top_grids, reports.decomposition_by_time,
    reports.toll_heavy_grids,
])
def test_reports_on_empty_input(spark, report):
    empty = spark.createDataFrame([], TRIP_SCHEMA)
    assert report(empty).count() == 0


def test_exact_percentiles_split_a_hot_group_across_slices(spark):
    import random

    rnd = random.Random(7)
    rows = [("hot", float(rnd.randint(0, 400))) for _ in range(3000)]        # many repeats
    rows += [("warm", rnd.random() * 100) for _ in range(301)]               # all distinct
    rows += [("tiny", 5.0), ("nulls", None), ("nulls", None), (None, 2.0), (None, 9.0), ("hot", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    levels = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99}
    from farewise.operators import exact_percentiles

    got = {r.g: r for r in exact_percentiles(df, ["g"], "v", levels, count_as="n", num_slices=7).collect()}
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for name, p in levels.items():
            assert got[g][name] == _disc(vs, p), (g, name)
        assert got[g]["n"] == len(vs)


@pytest.mark.parametrize("method", ["bracket", "kll", "sketch", "exact"])
def test_methods_agree_at_test_scale(spark, method):
    from farewise.operators import group_stats

    rows = [(i % 3, float((i * 7919) % 1000) / 7.0, float(i % 11)) for i in range(5000)]
    df = spark.createDataFrame(rows, "g int, v double, w double").repartition(6)
    q = {"a": ("v", 0.25), "b": ("v", 0.5), "c": ("v", 0.75), "d": ("w", 0.9)}
    got = sorted(tuple(r) for r in group_stats(df, ["g"], count_as="n", means={"m": "w"}, quantiles=q,
                                               method=method, salts=4)
                 .select("g", "n", "m", "a", "b", "c", "d").collect())
    want = []
    for g in range(3):
        vs = [r[1] for r in rows if r[0] == g]
        ws = [r[2] for r in rows if r[0] == g]
        want.append((g, len(vs), pytest.approx(sum(ws) / len(ws)), _disc(vs, 0.25), _disc(vs, 0.5),
                     _disc(vs, 0.75), _disc(ws, 0.9)))
    assert got == want


def test_unknown_percentile_method(spark):
    from farewise.operators import group_stats

    df = spark.createDataFrame([(1, 1.0)], "g int, v double")
    with pytest.raises(ValueError):
        group_stats(df, ["g"], quantiles={"a": ("v", 0.5)}, method="median-of-medians")


def test_bracket_percentiles_are_exact_and_repeatable_beyond_the_sketch(spark):
    """A hot group far larger than its sketch, ties, a wide range and infinities; every call gives the same."""
    from farewise.operators import group_stats

    inf = float("inf")
    rows = [("hot", float((i * 7919) % 20011) / 3.0) for i in range(20000)] + [("tied", 5.0)] * 900 + [("tied", 6.0)] * 100
    rows += [("wide", x) for x in [-inf] * 40 + [float(i) ** 5 for i in range(300)] + [inf] * 60]
    rows += [("cold", 1.0), ("cold", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(16)
    q = {"p01": ("v", 0.01), "p50": ("v", 0.5), "p90": ("v", 0.9), "p100": ("v", 1.0)}
    calls = [{r.g: r for r in group_stats(df, ["g"], count_as="n", quantiles=q, method="bracket", kll_k=64,
                                          salts=5).collect()} for _ in range(2)]
    assert calls[0] == calls[1]
    for g in ("hot", "tied", "wide", "cold", "none"):
        vs = [v for k, v in rows if k == g]
        assert calls[0][g].n == len(vs)
        for name, (_, p) in q.items():
            assert calls[0][g][name] == _disc(vs, p), (g, name)


def test_bracket_looks_up_missed_ranks_in_the_whole_group(spark, monkeypatch):
    """Brackets of no width miss their ranks; the answer stays exact."""
    from farewise.operators import group_stats, quantiles

    monkeypatch.setattr(quantiles, "BRACKET_ERRORS", 0)
    rows = [(i % 2, float((i * 7919) % 10007)) for i in range(6000)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(5)
    got = {r.g: r for r in group_stats(df, ["g"], quantiles={"a": ("v", 0.3), "b": ("v", 0.77)}, method="bracket",
                                       kll_k=8).collect()}
    for g in (0, 1):
        vs = [v for k, v in rows if k == g]
        assert (got[g].a, got[g].b) == (_disc(vs, 0.3), _disc(vs, 0.77))


@pytest.mark.parametrize("method", ["bracket", "kll", "sketch", "exact"])
def test_nan_takes_no_part_in_percentiles(spark, method):
    from farewise.operators import group_stats

    rows = [("a", float(i)) for i in range(9)] + [("a", float("nan"))] * 5 + [("b", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {r.g: r for r in group_stats(df, ["g"], count_as="n", quantiles={"m": ("v", 0.5), "h": ("v", 0.9)},
                                       method=method).collect()}
    assert (got["a"].n, got["a"].m, got["a"].h) == (14, 4.0, 8.0)
    assert (got["b"].n, got["b"].m) == (1, None)


def test_kll_two_level_merge_with_hot_group(spark):
    from farewise.operators import group_stats

    rows = [("hot", float(i % 997) / 3.0) for i in range(20000)] + [("cold", 1.0), ("cold", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(16)
    got = {r.g: r for r in group_stats(df, ["g"], count_as="n", quantiles={"p50": ("v", 0.5), "p99": ("v", 0.99)},
                                       method="kll", salts=5).collect()}
    for g in ("hot", "cold", "none"):
        vs = [v for k, v in rows if k == g]
        assert got[g].n == len(vs)
        assert got[g].p50 == _disc(vs, 0.5) and got[g].p99 == _disc(vs, 0.99)


def test_top_keys_by_buckets_equals_the_full_count(spark):
    from pyspark.sql import functions as F

    # a third of the rows hold three hot keys, the rest some 6,000 keys; nulls take no part
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 9 - 100).when(F.col("id") % 101 == 0, None)
        .otherwise(F.col("id") % 6000).alias("k"))
    for n in (0, 1, 3, 5):                            # beyond three keys the bound does not decide
        for buckets in (2, 64, 4096):
            want = [tuple(r) for r in top_keys(rows, "k", n).collect()]
            assert [tuple(r) for r in top_keys(rows, "k", n, "buckets", buckets).orderBy(F.desc("_n"), "k").collect()] == want
    assert top_keys(rows.limit(0), "k", 3, "buckets").count() == 0
    few = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    assert [tuple(r) for r in top_keys(few, "k", 9, "buckets").orderBy("k").collect()] == [("a", 2), ("b", 1)]
    kept = keep_top_n(few, "k", 1, "top", method="buckets").collect()
    assert sorted(r.top for r in kept) == ["a", "a", "other", "other"]
