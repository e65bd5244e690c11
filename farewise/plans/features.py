"""Feature steps shared by the reports and the modelling table (all narrow projections)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewise.config import DEFAULT, FareConfig, P_MEDIAN
from farewise.functions import (
    bucketize, day_name, grid_bin, grid_id, is_weekend, pickup_date, pickup_hour, share, sum_components, unit_rate,
)
from farewise.operators import clean, group_stats, with_group_stat
from farewise.operators.profiles import FARE_PER_MILE
from farewise.session import materialize

REGIME = "distance_regime"
HOUR = "pickup_hour"
WEEKEND = "is_weekend"
LAT_BIN = "pickup_lat_bin"
LON_BIN = "pickup_lon_bin"
GRID = "pickup_grid"
MEDIAN_RATE = "median_fare_per_mile"


def with_calendar(df: DataFrame, cfg: FareConfig = DEFAULT, with_date: bool = False) -> DataFrame:
    ts = cfg.cols.pickup_ts
    cols = {HOUR: pickup_hour(ts), "pickup_dow": day_name(ts), WEEKEND: is_weekend(ts)}
    if with_date:
        cols["pickup_date"] = pickup_date(ts)
    return df.withColumns(cols)


def with_grid(df: DataFrame, cfg: FareConfig = DEFAULT, with_id: bool = False) -> DataFrame:
    cols = {LAT_BIN: grid_bin(cfg.cols.pickup_lat, cfg.grid_digits),
            LON_BIN: grid_bin(cfg.cols.pickup_lon, cfg.grid_digits)}
    df = df.withColumns(cols)
    return df.withColumn(GRID, grid_id(LAT_BIN, LON_BIN)) if with_id else df


def with_regime(df: DataFrame, cfg: FareConfig = DEFAULT) -> DataFrame:
    return df.withColumn(REGIME, bucketize(cfg.cols.distance, cfg.regime_edges, cfg.regime_labels))


def with_components(df: DataFrame, cfg: FareConfig = DEFAULT, with_shares: bool = True) -> DataFrame:
    """fixed_fees = extra + mta_tax + improvement_surcharge (nulls as 0), tolls = tolls_amount or 0,
    and both as a share of the fare (not of the total)."""
    c = cfg.cols
    df = df.withColumns({
        "fixed_fees": sum_components([c.extra, c.mta_tax, c.surcharge]),
        "tolls": F.coalesce(F.col(c.tolls), F.lit(0.0)),
    })
    if with_shares:
        df = df.withColumns({
            "fixed_fee_share": share("fixed_fees", c.fare),
            "toll_share": share("tolls", c.fare),
        })
    return df


def regime_rate_baseline(df: DataFrame, cfg: FareConfig = DEFAULT, count_as: str | None = None) -> DataFrame:
    """Median fare per mile of each distance regime (one row per regime)."""
    stats = group_stats(df, [REGIME], count_as=count_as, quantiles={MEDIAN_RATE: (FARE_PER_MILE, P_MEDIAN)},
                        method=cfg.percentile_method, accuracy=cfg.percentile_accuracy, kll_k=cfg.kll_k)
    return stats.select(REGIME, MEDIAN_RATE, *([count_as] if count_as else []))


def with_baseline_deviation(df: DataFrame, cfg: FareConfig = DEFAULT, baseline: DataFrame | None = None) -> DataFrame:
    """Attach the regime baseline to each trip: expected fare, signed and absolute deviation.

    The baseline (computed here, or passed in when already known) has at most
    one row per regime label, so it is broadcast and the trips are never
    shuffled for the join.
    """
    c = cfg.cols
    # written: the statistics of the result scan the trips more than once, and would derive the baseline each time
    stats = materialize(regime_rate_baseline(df, cfg), "baseline") if baseline is None else baseline.select(REGIME, MEDIAN_RATE)
    joined = with_group_stat(df, stats, [REGIME], max_groups=len(cfg.regime_labels))
    expected = F.col(c.distance) * F.col(MEDIAN_RATE)
    return joined.withColumn("expected_fare_baseline", expected).withColumns({
        "fare_deviation": F.col(c.fare) - F.col("expected_fare_baseline"),
        "abs_deviation": F.abs(F.col(c.fare) - F.col("expected_fare_baseline")),
    })


def prepare(trips: DataFrame, profile: str, cfg: FareConfig = DEFAULT) -> DataFrame:
    """Cleaned trips of a profile with the features its reports use."""
    df = clean(trips, profile, cfg)
    if profile == "analytics":
        return with_calendar(df, cfg, with_date=True)
    if profile == "baseline":
        df = with_regime(df, cfg)
        return df.withColumn(FARE_PER_MILE, unit_rate(cfg.cols.fare, cfg.cols.distance))
    if profile == "deviation":
        return with_grid(with_calendar(with_regime(df, cfg), cfg), cfg)
    if profile == "decomposition":
        return with_components(with_grid(with_calendar(with_regime(df, cfg), cfg), cfg), cfg)
    if profile == "modelling":
        df = with_grid(with_calendar(df, cfg), cfg, with_id=True)
        return with_regime(with_components(df, cfg, with_shares=False), cfg)
    raise ValueError(f"unknown profile {profile!r}")
