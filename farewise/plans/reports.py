"""The analysis reports: demand, payments, hotspots, regime baselines, deviations, decomposition.

Each report is three parts:

* the frame of its cleaning profile with the features all reports of that
  profile read (``analytics_frame``, ``deviation_frame``, ``decomposition_frame``);
* the group keys and the statistics it needs (``ReportSpec``);
* a finishing projection over the per-group statistics (rounding, HAVING,
  sort or top-k).

A single report computes its statistics with ``group_stats``; the runner
(``plans.runner``) computes the statistics of every report of a profile in
one GROUPING SETS pass over one scan. Money and distance are summed exactly
(``functions.exact_sum``: independent of partitioning; NaN and infinities come out
as a plain sum gives them); durations from whole seconds.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewise.config import (
    DEFAULT, MIN_GROUP_TRIPS, P_HIGH, P_LOW, P_MEDIAN, PAYMENT_LABELS, PAYMENT_OTHER,
    TOP_DEVIATION_GRIDS, TOP_PICKUP_GRIDS, TOP_TOLL_GRIDS, FareConfig,
)
from farewise.functions import decode, duration_seconds, grid_bin, within_bbox
from farewise.operators import group_stats, group_stats_sets, top_k
from farewise.operators import within_bbox as keep_within_bbox
from farewise.plans.features import (
    HOUR, LAT_BIN, LON_BIN, MEDIAN_RATE, REGIME, WEEKEND, prepare, regime_rate_baseline, with_baseline_deviation,
)

PAYMENT = "payment_label"
TIME_KEYS = (REGIME, WEEKEND, HOUR)
CELL_KEYS = (REGIME, LAT_BIN, LON_BIN)


# ---------------------------------------------------------------- profile frames

def analytics_frame(trips: DataFrame, cfg: FareConfig = DEFAULT, mapping: Mapping | None = None) -> DataFrame:
    """Analytics profile with hour, weekend, payment label, measures, and grid
    cells of pickups inside the bounding box (null outside)."""
    c = cfg.cols
    inside = within_bbox(c.pickup_lat, c.pickup_lon, cfg.bbox_lat, cfg.bbox_lon)
    return prepare(trips, "analytics", cfg).select(
        HOUR, WEEKEND,
        decode(c.payment, PAYMENT_LABELS if mapping is None else mapping, PAYMENT_OTHER).alias(PAYMENT),
        F.when(inside, grid_bin(c.pickup_lat, cfg.grid_digits)).alias(LAT_BIN),
        F.when(inside, grid_bin(c.pickup_lon, cfg.grid_digits)).alias(LON_BIN),
        F.col(c.distance).alias("_dist"),
        duration_seconds(c.pickup_ts, c.dropoff_ts).alias("_secs"),
        F.col(c.total).alias("_total"),
        F.col(c.tip).alias("_tip"),
    )


def deviation_frame(trips: DataFrame, cfg: FareConfig = DEFAULT) -> DataFrame:
    """Deviation profile with each trip's deviation from its regime baseline."""
    dev = with_baseline_deviation(prepare(trips, "deviation", cfg), cfg)
    return dev.select(*TIME_KEYS, LAT_BIN, LON_BIN, "fare_deviation", "abs_deviation")


def decomposition_frame(trips: DataFrame, cfg: FareConfig = DEFAULT) -> DataFrame:
    return prepare(trips, "decomposition", cfg).select(
        *TIME_KEYS, LAT_BIN, LON_BIN, "fixed_fees", "tolls", "fixed_fee_share", "toll_share")


FRAMES: dict[str, Callable[..., DataFrame]] = {
    "analytics": analytics_frame,
    "deviation": deviation_frame,
    "decomposition": decomposition_frame,
}


# ---------------------------------------------------------------- finishing projections

def _hourly(st: DataFrame, cfg: FareConfig) -> DataFrame:
    return st.select(
        HOUR, F.col("trips").alias("total_trips"),
        F.round("_mean_dist", 2).alias("avg_trip_distance_miles"),
        F.round(F.col("_mean_secs") / F.lit(60.0), 2).alias("avg_trip_duration_mins"),
        F.round("_sum_total", 2).alias("total_revenue_usd"),
    ).orderBy(HOUR)


def _weekend(st: DataFrame, cfg: FareConfig) -> DataFrame:
    return st.select(WEEKEND, HOUR, "trips", F.round("_mean_total", 2).alias("avg_total_amount_usd")) \
        .orderBy(WEEKEND, HOUR)


def _payment(st: DataFrame, cfg: FareConfig) -> DataFrame:
    return st.select(PAYMENT, "trips", F.round("_sum_total", 2).alias("revenue_usd"),
                     F.round("_mean_tip", 2).alias("avg_tip_usd")).orderBy(F.desc("trips"), PAYMENT)


def _pickup_grids(st: DataFrame, cfg: FareConfig, k: int = TOP_PICKUP_GRIDS) -> DataFrame:
    # pickups outside the box form the (null, null) cell, which is not a cell
    cells = st.filter(F.col(LAT_BIN).isNotNull()).select(
        LAT_BIN, LON_BIN, "trips", F.round("_mean_total", 2).alias("avg_total_amount_usd"))
    return top_k(cells, [F.desc("trips")], k, [LAT_BIN, LON_BIN])


def _deviation_time(st: DataFrame, cfg: FareConfig) -> DataFrame:
    return st.select(
        *TIME_KEYS, "trips",
        F.round("_abs50", 2).alias("median_abs_dev"),
        F.round("_abs90", 2).alias("p90_abs_dev"),
        F.round("_mean_dev", 2).alias("avg_dev"),
    ).orderBy(*TIME_KEYS)


def _deviation_cells(st: DataFrame, cfg: FareConfig, min_trips: int = MIN_GROUP_TRIPS,
                     k: int = TOP_DEVIATION_GRIDS) -> DataFrame:
    cells = st.filter(F.col("trips") >= min_trips).select(
        *CELL_KEYS, "trips", F.round("_abs90", 2).alias("p90_abs_dev"), F.round("_abs50", 2).alias("median_abs_dev"))
    return top_k(cells, [F.desc("p90_abs_dev")], k, list(CELL_KEYS))


def _decomposition_time(st: DataFrame, cfg: FareConfig) -> DataFrame:
    return st.select(
        *TIME_KEYS, "trips",
        F.round("_fixed50", 2).alias("median_fixed_fees"),
        F.round("_tolls50", 2).alias("median_tolls"),
        F.round("_share50", 3).alias("median_fixed_fee_share"),
        F.round("_toll_share90", 3).alias("p90_toll_share"),
    ).orderBy(*TIME_KEYS)


def _toll_cells(st: DataFrame, cfg: FareConfig, min_trips: int = MIN_GROUP_TRIPS,
                k: int = TOP_TOLL_GRIDS) -> DataFrame:
    cells = st.filter(F.col("trips") >= min_trips).select(
        *CELL_KEYS, "trips", F.round("_tolls50", 2).alias("median_tolls"), F.round("_tolls90", 2).alias("p90_tolls"))
    return top_k(cells, [F.desc("p90_tolls")], k, list(CELL_KEYS))


# ---------------------------------------------------------------- specs

@dataclass(frozen=True)
class ReportSpec:
    profile: str
    keys: tuple[str, ...]
    finish: Callable[..., DataFrame]
    sums: Mapping[str, str] = field(default_factory=dict)
    means: Mapping[str, str] = field(default_factory=dict)
    quantiles: Mapping[str, tuple[str, float]] = field(default_factory=dict)
    grid_params: bool = False  # finish takes min_trips and k


_ABS = {"_abs50": ("abs_deviation", P_MEDIAN), "_abs90": ("abs_deviation", P_HIGH)}
_TOLLS = {"_tolls50": ("tolls", P_MEDIAN), "_tolls90": ("tolls", P_HIGH)}

SPECS: dict[str, ReportSpec] = {
    "hourly_demand_revenue": ReportSpec(
        "analytics", (HOUR,), _hourly, sums={"_sum_total": "_total"},
        means={"_mean_dist": "_dist", "_mean_secs": "_secs"}),
    "weekend_vs_weekday_hourly": ReportSpec(
        "analytics", (WEEKEND, HOUR), _weekend, means={"_mean_total": "_total"}),
    "payment_split": ReportSpec(
        "analytics", (PAYMENT,), _payment, sums={"_sum_total": "_total"}, means={"_mean_tip": "_tip"}),
    "top_pickup_grids": ReportSpec(
        "analytics", (LAT_BIN, LON_BIN), _pickup_grids, means={"_mean_total": "_total"}),
    "deviation_by_time": ReportSpec(
        "deviation", TIME_KEYS, _deviation_time, means={"_mean_dev": "fare_deviation"}, quantiles=_ABS),
    "deviation_top_grids": ReportSpec(
        "deviation", CELL_KEYS, _deviation_cells, quantiles=_ABS, grid_params=True),
    "decomposition_by_time": ReportSpec(
        "decomposition", TIME_KEYS, _decomposition_time,
        quantiles={"_fixed50": ("fixed_fees", P_MEDIAN), "_tolls50": ("tolls", P_MEDIAN),
                   "_share50": ("fixed_fee_share", P_MEDIAN), "_toll_share90": ("toll_share", P_HIGH)}),
    "toll_heavy_grids": ReportSpec(
        "decomposition", CELL_KEYS, _toll_cells, quantiles=_TOLLS, grid_params=True),
}


def spec_stats(frame: DataFrame, names: list[str], cfg: FareConfig = DEFAULT) -> tuple[DataFrame, dict[str, int]]:
    """Statistics of several reports of one profile in one pass (GROUPING SETS over their
    distinct key sets). Returns the statistics and, per report, its value of ``_set``."""
    specs = [SPECS[n] for n in names]
    sets: list[tuple[str, ...]] = []
    sums, means, quantiles = {}, {}, {}
    reads: dict[int, list[str]] = {}
    for s in specs:
        if s.keys not in sets:
            sets.append(s.keys)
        some = reads.setdefault(sets.index(s.keys), [])
        some += [c for c in dict.fromkeys(c for c, _ in s.quantiles.values()) if c not in some]
        sums.update(s.sums)
        means.update(s.means)
        quantiles.update(s.quantiles)
    stats = group_stats_sets(frame, [list(k) for k in sets], count_as="trips", sums=sums, means=means,
                             quantiles=quantiles, method=cfg.percentile_method, accuracy=cfg.percentile_accuracy,
                             kll_k=cfg.kll_k, reads=reads)
    return stats, {n: sets.index(SPECS[n].keys) for n in names}


def finish(name: str, stats: DataFrame, cfg: FareConfig = DEFAULT, min_trips: int = MIN_GROUP_TRIPS,
           k: int | None = None) -> DataFrame:
    """The report ``name`` from its group statistics."""
    spec = SPECS[name]
    if spec.grid_params:
        return spec.finish(stats, cfg, min_trips, k) if k else spec.finish(stats, cfg, min_trips)
    if k and name == "top_pickup_grids":
        return spec.finish(stats, cfg, k)
    return spec.finish(stats, cfg)


def _single(name: str, trips: DataFrame, cfg: FareConfig, frame: DataFrame | None = None, **params) -> DataFrame:
    spec = SPECS[name]
    frame = FRAMES[spec.profile](trips, cfg) if frame is None else frame
    stats = group_stats(frame, list(spec.keys), count_as="trips", sums=spec.sums, means=spec.means,
                        quantiles=spec.quantiles, method=cfg.percentile_method, accuracy=cfg.percentile_accuracy,
                        kll_k=cfg.kll_k, min_rows=params.get("min_trips", 1) if spec.grid_params else 1)
    return finish(name, stats, cfg, **params)


# ---------------------------------------------------------------- public reports

def hourly_demand_revenue(trips: DataFrame, cfg: FareConfig = DEFAULT) -> DataFrame:
    return _single("hourly_demand_revenue", trips, cfg)


def weekend_vs_weekday_hourly(trips: DataFrame, cfg: FareConfig = DEFAULT) -> DataFrame:
    return _single("weekend_vs_weekday_hourly", trips, cfg)


def payment_split(trips: DataFrame, cfg: FareConfig = DEFAULT, mapping: Mapping | None = None) -> DataFrame:
    return _single("payment_split", trips, cfg, analytics_frame(trips, cfg, mapping))


def top_pickup_grids(trips: DataFrame, cfg: FareConfig = DEFAULT, k: int = TOP_PICKUP_GRIDS) -> DataFrame:
    # alone, the box is a row filter (pushed to the reader); in the suite the
    # other analytics reports need the rows outside it
    return _single("top_pickup_grids", trips, cfg, analytics_frame(keep_within_bbox(trips, cfg), cfg), k=k)


def regime_baseline(trips: DataFrame, cfg: FareConfig = DEFAULT) -> DataFrame:
    """Median fare per mile and trips per distance regime (baseline profile)."""
    return regime_rate_baseline(prepare(trips, "baseline", cfg), cfg, count_as="trips").orderBy(REGIME)


def regime_deviation_summary_from(base: DataFrame, cfg: FareConfig = DEFAULT,
                                  baseline: DataFrame | None = None) -> DataFrame:
    """Deviation summary of a prepared baseline-profile frame; ``baseline`` may be a
    precomputed regime baseline (the runner shares it with ``regime_baseline``)."""
    dev = with_baseline_deviation(base, cfg, baseline)
    stats = group_stats(dev, [REGIME], count_as="trips", means={"_avg": "fare_deviation"},
                        quantiles={"_p50": ("fare_deviation", P_MEDIAN), "_p90": ("fare_deviation", P_HIGH),
                                   "_p10": ("fare_deviation", P_LOW)},
                        method=cfg.percentile_method, accuracy=cfg.percentile_accuracy, kll_k=cfg.kll_k)
    return stats.select(
        REGIME, "trips",
        F.round("_avg", 2).alias("avg_deviation"),
        F.round("_p50", 2).alias("median_deviation"),
        F.round("_p90", 2).alias("p90_deviation"),
        F.round("_p10", 2).alias("p10_deviation"),
    ).orderBy(REGIME)


def regime_deviation_summary(trips: DataFrame, cfg: FareConfig = DEFAULT) -> DataFrame:
    return regime_deviation_summary_from(prepare(trips, "baseline", cfg), cfg)


def deviation_by_time(trips: DataFrame, cfg: FareConfig = DEFAULT) -> DataFrame:
    return _single("deviation_by_time", trips, cfg)


def deviation_top_grids(trips: DataFrame, cfg: FareConfig = DEFAULT, min_trips: int = MIN_GROUP_TRIPS,
                        k: int = TOP_DEVIATION_GRIDS) -> DataFrame:
    """Cells by p90 absolute deviation among cells with at least ``min_trips`` trips.

    No bounding box here: the (0, 0) cell and a null cell are reported too.
    The p90 is rounded before sorting; group keys break ties.
    """
    return _single("deviation_top_grids", trips, cfg, min_trips=min_trips, k=k)


def decomposition_by_time(trips: DataFrame, cfg: FareConfig = DEFAULT) -> DataFrame:
    return _single("decomposition_by_time", trips, cfg)


def toll_heavy_grids(trips: DataFrame, cfg: FareConfig = DEFAULT, min_trips: int = MIN_GROUP_TRIPS,
                     k: int = TOP_TOLL_GRIDS) -> DataFrame:
    return _single("toll_heavy_grids", trips, cfg, min_trips=min_trips, k=k)


__all__ = [
    "hourly_demand_revenue", "weekend_vs_weekday_hourly", "payment_split", "top_pickup_grids",
    "regime_baseline", "regime_deviation_summary", "deviation_by_time", "deviation_top_grids",
    "decomposition_by_time", "toll_heavy_grids", "SPECS", "FRAMES", "spec_stats", "finish", "MEDIAN_RATE",
]
