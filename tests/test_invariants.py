"""Invariants between reports (sf0.01) and the runner's shared-input path."""

import pytest
from pyspark.sql import functions as F

from farewise.operators import clean
from farewise.plans import reports
from farewise.plans.catalog import MIN_TRIPS_TEST
from farewise.plans.runner import run_reports
from farewise.sources import load_trips

from conftest import SF_MED


@pytest.fixture(scope="module")
def trips(spark):
    return load_trips(spark, SF_MED)


def _total(df, col="trips"):
    return df.agg(F.sum(col)).first()[0]


def test_profile_totals(trips):
    n_analytics = clean(trips, "analytics").count()
    assert n_analytics == 8904
    assert _total(reports.hourly_demand_revenue(trips), "total_trips") == n_analytics
    assert _total(reports.weekend_vs_weekday_hourly(trips)) == n_analytics
    assert _total(reports.payment_split(trips)) == n_analytics
    assert _total(reports.regime_baseline(trips)) == _total(reports.regime_deviation_summary(trips)) == 9592
    assert _total(reports.deviation_by_time(trips)) == 9444
    assert _total(reports.decomposition_by_time(trips)) == 9231


def test_row_counts_fall_through_profiles(trips):
    counts = [trips.count()] + [clean(trips, p).count() for p in ("deviation", "decomposition", "modelling")]
    assert counts == sorted(counts, reverse=True)


def test_regimes_partition_and_percentiles_ordered(trips):
    summary = reports.regime_deviation_summary(trips).collect()
    assert {r.distance_regime for r in summary} == {"short", "medium", "long"}
    for r in summary:
        assert r.p10_deviation <= r.median_deviation <= r.p90_deviation
        assert r.median_deviation == 0.0  # deviation = distance * (rate - median rate)
    by_regime = {r.distance_regime: r.trips for r in reports.deviation_by_time(trips).groupBy("distance_regime")
                 .agg(F.sum("trips").alias("trips")).collect()}
    assert by_regime == {"short": 540, "medium": 2548, "long": 6356}


def test_grid_reports_threshold_and_cut(trips):
    grids = reports.deviation_top_grids(trips, min_trips=MIN_TRIPS_TEST).collect()
    assert len(grids) == 100 and min(r.trips for r in grids) >= MIN_TRIPS_TEST
    p90 = [r.p90_abs_dev for r in grids]
    assert p90 == sorted(p90, reverse=True)
    assert reports.toll_heavy_grids(trips).count() == 0  # published threshold of 5000 trips


@pytest.mark.parametrize("method", ["bracket", "sketch", "exact"])
def test_runner_equals_single_reports(trips, method):
    """The runner's two-scan plan (GROUPING SETS, masked statistics) equals the single reports."""
    from dataclasses import replace

    from farewise.config import DEFAULT

    cfg = replace(DEFAULT, percentile_method=method)
    shared = run_reports(trips, cfg, min_trips=MIN_TRIPS_TEST)
    assert len(shared) == 10
    for name, rows in shared.items():
        fn = getattr(reports, name)
        single = fn(trips, cfg, min_trips=MIN_TRIPS_TEST) if name in ("deviation_top_grids", "toll_heavy_grids") \
            else fn(trips, cfg)
        assert rows == single.collect(), name
