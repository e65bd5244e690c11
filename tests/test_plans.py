"""Plan shapes that the scale design depends on (read from explain('formatted'))."""

import contextlib
import io
import re
from dataclasses import replace

import pytest

from farewise.config import DEFAULT
from farewise.plans import catalog
from farewise.plans import reports as R
from farewise.session import materialize
from farewise.sources import trips_table

from conftest import SF_SMALL


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


#: The percentile method that needs one scan per aggregate: with it the plans show which aggregates share a scan.
ONE_SCAN = replace(DEFAULT, percentile_method="kll")

REPORTS = ["hourly_demand_revenue", "weekend_vs_weekday_hourly", "payment_split", "top_pickup_grids",
           "regime_baseline", "regime_deviation_summary", "deviation_by_time", "deviation_top_grids",
           "decomposition_by_time", "toll_heavy_grids", "ml_fare_dataset", "topn_or_other"]


@pytest.mark.parametrize("name", REPORTS)
def test_report_plans_prune_push_down_and_never_pair_rows(spark, name):
    plan = _plan(catalog.QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "PushedFilters: [IsNotNull(" in plan            # profile predicates reach the reader
    # scans of the trips (others read small written statistics)
    widths = [len(s.split(",")) for s in re.findall(r"ReadSchema: struct<(.*)>", plan) if "trip_distance" in s or "total_amount" in s]
    assert widths and max(widths) <= 12                   # never the whole 20-column trip row
    # joins against group statistics are broadcasts: the trips are never shuffled for them
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


@pytest.mark.parametrize("name", ["top_pickup_grids", "deviation_top_grids", "toll_heavy_grids"])
def test_top_k_is_take_ordered(spark, name):
    plan = _plan(catalog.QUERIES[name](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_percentile_reports_merge_sketches_in_two_levels(spark):
    plan = _plan(R.deviation_by_time(trips_table(spark, SF_SMALL), ONE_SCAN))
    assert "kll_sketch_agg_double" in plan and "kll_merge_agg_double" in plan
    assert "percentile_approx" not in plan
    assert re.search(r"hashpartitioning\([^)]*_salt", plan)


def test_digit_percentiles_are_hash_aggregates(spark, monkeypatch):
    """No sketch and no sort of a group in any of the scans: counts by digits, and broadcasts of the chosen ones."""
    from farewise.operators import quantiles

    plans = []

    def written(df, name):
        plans.append(_plan(df))
        return materialize(df, name)

    monkeypatch.setattr(quantiles, "materialize", written)
    for rows, scans in ((quantiles.VALUE_ROWS, 2), (0, 3)):  # 0: a further digit however few the rows
        monkeypatch.setattr(quantiles, "VALUE_ROWS", rows)
        plans.clear()
        plans.append(_plan(R.regime_baseline(trips_table(spark, SF_SMALL))))
        assert all("ObjectHashAggregate" not in p and "SortAggregate" not in p for p in plans)
        of_trips = [p for p in plans if "trip_distance" in p]
        assert len(of_trips) == scans and all("PushedFilters: [IsNotNull(" in p for p in of_trips)
        assert sum(p.count("\n(") > 0 and "BroadcastHashJoin" in p for p in of_trips) >= scans - 1


def _scans(plan: str) -> int:
    return len(re.findall(r"^\(\d+\) Scan parquet", plan, flags=re.M))


def test_runner_reads_each_profile_once(spark):
    trips = trips_table(spark, SF_SMALL)
    names = ["hourly_demand_revenue", "weekend_vs_weekday_hourly", "payment_split", "top_pickup_grids"]
    plan = _plan(R.spec_stats(R.FRAMES["analytics"](trips), names)[0])
    assert _scans(plan) == 1 and "Expand" in plan
    plan = _plan(R.spec_stats(R.FRAMES["deviation"](trips, ONE_SCAN), ["deviation_by_time", "deviation_top_grids"], ONE_SCAN)[0])
    assert _scans(plan) == 2                         # regime baseline + the combined aggregate
    assert "BroadcastHashJoin" in plan


def test_reports_with_equal_keys_share_one_set(spark):
    trips = trips_table(spark, SF_SMALL)
    stats, index = R.spec_stats(R.FRAMES["analytics"](trips), ["hourly_demand_revenue", "hourly_demand_revenue",
                                                                "payment_split"])
    assert index == {"hourly_demand_revenue": 0, "payment_split": 1}
    assert {r[0] for r in stats.select("_set").distinct().collect()} == {0, 1}


def test_report_suite_reads_the_trips_twice(spark):
    from farewise.plans.runner import REPORT_NAMES, plan_reports

    frames, _ = plan_reports(trips_table(spark, SF_SMALL), ONE_SCAN, names=list(REPORT_NAMES), min_trips=5, persist=False)
    # analytics reports and the regime baseline: one GROUPING SETS scan
    for name in ("hourly_demand_revenue", "top_pickup_grids", "regime_baseline"):
        plan = _plan(frames[name])
        assert _scans(plan) == 1 and "Expand" in plan, name
    # deviation reports: that scan's baselines + one more GROUPING SETS scan
    for name in ("regime_deviation_summary", "deviation_by_time"):
        plan = _plan(frames[name])
        assert _scans(plan) == 2 and "Expand" in plan and "BroadcastHashJoin" in plan, name
    assert _scans(_plan(frames["toll_heavy_grids"])) <= 2


def test_profile_flags_select_exactly_the_profile_rows(spark):
    from pyspark.sql import functions as F

    from farewise.operators import clean
    from farewise.plans.runner import fares_frame
    from farewise.sources import load_trips

    trips = load_trips(spark, SF_SMALL)
    # compare row multisets on the columns both sides carry
    flags = fares_frame(trips.withColumn("trip_distance", F.col("trip_distance")))
    for flag, profile in (("_dev", "deviation"), ("_dec", "decomposition")):
        got = sorted(tuple(r) for r in flags.filter(F.col(flag)).select("trip_distance", "fare_amount").collect())
        want = sorted(tuple(r) for r in clean(trips, profile).select("trip_distance", "fare_amount").collect())
        assert got == want, profile
    # the first pass masks values to the analytics and baseline profiles
    from farewise.functions import duration_seconds, unit_rate
    from farewise.plans.runner import first_pass_frame

    first = first_pass_frame(trips)
    got = sorted(tuple(r) for r in first.filter(F.col("_one_ana") == 1).select("_dist", "_secs", "_total").collect())
    want = sorted(tuple(r) for r in clean(trips, "analytics").select(
        "trip_distance", duration_seconds("tpep_pickup_datetime", "tpep_dropoff_datetime"), "total_amount").collect())
    assert got == want
    got = sorted(r[0] for r in first.filter(F.col("_one_base") == 1).select("_rate_b").collect())
    want = sorted(r[0] for r in clean(trips, "baseline").select(unit_rate("fare_amount", "trip_distance")).collect())
    assert got == want
