"""Run the report suite in two scans of the trips.

Reports differ only in their group keys, statistics and row subset, so the
runner computes them with GROUPING SETS aggregates (every key set comes out
of the same Expand -> partial aggregate -> shuffle) over profile-masked
columns (a value is null outside its report's profile and is not
aggregated; row counts are sums of 0/1 flags):

* scan 1 (rows of the analytics or the baseline profile): R1-R4, R5 and both
  regime baselines — the deviation profile is a subset of the baseline
  profile, so its baseline is a masked statistic of the same rows;
* scan 2 (baseline-profile rows, baselines broadcast): R6-R10.

The per-group results are small; they are persisted and each report's
finishing projection (rounding, HAVING, sort or top-k) reads them. Finishing
jobs are submitted concurrently so their small stages fill idle executors.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewise.config import (
    DEFAULT, MIN_GROUP_TRIPS, P_HIGH, P_LOW, P_MEDIAN, PAYMENT_LABELS, PAYMENT_OTHER, FareConfig,
)
from farewise.functions import (
    bucketize, decode, duration_seconds, grid_bin, is_weekend, pickup_hour, share, sum_components,
    unit_rate,
)
from farewise.functions import within_bbox as in_bbox
from farewise.operators import SET_COL, clean, group_stats_sets, with_group_stat
from farewise.operators.profiles import FARE_PER_MILE, profile_predicate
from farewise.plans import reports as R
from farewise.plans.features import HOUR, LAT_BIN, LON_BIN, MEDIAN_RATE, REGIME, WEEKEND
from farewise.session import materialize

REPORT_NAMES = [
    "hourly_demand_revenue", "weekend_vs_weekday_hourly", "payment_split", "top_pickup_grids",
    "regime_baseline", "regime_deviation_summary", "deviation_by_time", "deviation_top_grids",
    "decomposition_by_time", "toll_heavy_grids",
]


_FARE_REPORTS = ("regime_baseline", "regime_deviation_summary", "deviation_by_time", "deviation_top_grids",
                 "decomposition_by_time", "toll_heavy_grids")


def fares_frame(trips: DataFrame, cfg: FareConfig = DEFAULT) -> DataFrame:
    """Baseline-profile rows with the features of R5-R10 and membership flags of the
    deviation profile (``_dev``) and the decomposition profile (``_dec``).
    """
    c = cfg.cols
    rate = F.col(FARE_PER_MILE)
    base = clean(trips, "baseline", cfg).withColumn(FARE_PER_MILE, unit_rate(c.fare, c.distance))
    dev, dec = profile_predicate("deviation", cfg), profile_predicate("decomposition", cfg)
    fixed = sum_components([c.extra, c.mta_tax, c.surcharge])
    tolls = F.coalesce(F.col(c.tolls), F.lit(0.0))
    return base.select(
        bucketize(c.distance, cfg.regime_edges, cfg.regime_labels).alias(REGIME),
        pickup_hour(c.pickup_ts).alias(HOUR), is_weekend(c.pickup_ts).alias(WEEKEND),
        grid_bin(c.pickup_lat, cfg.grid_digits).alias(LAT_BIN), grid_bin(c.pickup_lon, cfg.grid_digits).alias(LON_BIN),
        F.col(c.distance), F.col(c.fare), rate,
        F.coalesce(dev, F.lit(False)).alias("_dev"), F.coalesce(dec, F.lit(False)).alias("_dec"),
        fixed.alias("fixed_fees"), tolls.alias("tolls"),
        share(fixed, c.fare).alias("fixed_fee_share"), share(tolls, c.fare).alias("toll_share"),
    )


def first_pass_frame(trips: DataFrame, cfg: FareConfig = DEFAULT) -> DataFrame:
    """Rows of the analytics or the baseline profile, each profile's values masked to its rows.

    One scan of this frame answers the analytics reports, R5 and both regime
    baselines (the deviation baseline over the deviation-profile rows).
    """
    c = cfg.cols
    secs = duration_seconds(c.pickup_ts, c.dropoff_ts)
    ana, base, dev = (profile_predicate(p, cfg) for p in ("analytics", "baseline", "deviation"))
    rate = unit_rate(c.fare, c.distance)
    inside = in_bbox(c.pickup_lat, c.pickup_lon, cfg.bbox_lat, cfg.bbox_lon)
    # distance >= 0 is implied by both profiles and, unlike their OR, reaches the Parquet reader
    flagged = trips.filter(F.col(c.distance) >= 0).withColumns({
        "_ana": F.coalesce(ana, F.lit(False)), "_base": F.coalesce(base, F.lit(False)),
        "_devf": F.coalesce(dev, F.lit(False))}).filter(F.col("_ana") | F.col("_base"))
    a, b = F.col("_ana"), F.col("_base")
    return flagged.select(
        pickup_hour(c.pickup_ts).alias(HOUR), is_weekend(c.pickup_ts).alias(WEEKEND),
        decode(c.payment, PAYMENT_LABELS, PAYMENT_OTHER).alias(R.PAYMENT),
        F.when(a & inside, grid_bin(c.pickup_lat, cfg.grid_digits)).alias(LAT_BIN),
        F.when(a & inside, grid_bin(c.pickup_lon, cfg.grid_digits)).alias(LON_BIN),
        F.when(a, F.col(c.distance)).alias("_dist"), F.when(a, secs).alias("_secs"),
        F.when(a, F.col(c.total)).alias("_total"), F.when(a, F.col(c.tip)).alias("_tip"),
        F.when(a, F.lit(1)).otherwise(F.lit(0)).alias("_one_ana"),
        bucketize(c.distance, cfg.regime_edges, cfg.regime_labels).alias(REGIME),
        F.when(b, rate).alias("_rate_b"), F.when(F.col("_devf"), rate).alias("_rate_dev"),
        F.when(b, F.lit(1)).otherwise(F.lit(0)).alias("_one_base"),
    )


#: Key set, row-count column, means and percentiles that each report of scan 2 reads.
_SCAN2 = {
    "regime_deviation_summary": ((REGIME,), "_rows", {"_avg": "_dev_b"},
                                 {"_p50": ("_dev_b", P_MEDIAN), "_p90": ("_dev_b", P_HIGH), "_p10": ("_dev_b", P_LOW)}),
    "deviation_by_time": (R.TIME_KEYS, "_n_dev", {"_mean_dev": "_dev_d"},
                          {"_abs50": ("_abs_d", P_MEDIAN), "_abs90": ("_abs_d", P_HIGH)}),
    "deviation_top_grids": (R.CELL_KEYS, "_n_dev", {}, {"_abs50": ("_abs_d", P_MEDIAN), "_abs90": ("_abs_d", P_HIGH)}),
    "decomposition_by_time": (R.TIME_KEYS, "_n_dec", {}, {
        "_fixed50": ("_m_fixed_fees", P_MEDIAN), "_tolls50": ("_m_tolls", P_MEDIAN),
        "_share50": ("_m_fixed_fee_share", P_MEDIAN), "_toll_share90": ("_m_toll_share", P_HIGH)}),
    "toll_heavy_grids": (R.CELL_KEYS, "_n_dec", {}, {"_tolls50": ("_m_tolls", P_MEDIAN), "_tolls90": ("_m_tolls", P_HIGH)}),
}


def _fare_reports(trips: DataFrame, cfg: FareConfig, names: list[str], min_trips: int, persist: bool,
                  out: dict[str, DataFrame], cached: list[DataFrame], baselines: DataFrame) -> None:
    c = cfg.cols
    fares = fares_frame(trips, cfg)
    rest = [n for n in names if n != "regime_baseline"]
    # scan 2: R6-R10 from one GROUPING SETS aggregate over profile-masked columns
    joined = with_group_stat(fares, baselines.select(REGIME, MEDIAN_RATE, "_median_dev"), [REGIME],
                             max_groups=len(cfg.regime_labels))
    dev, dec = F.col("_dev"), F.col("_dec")
    dev_d = F.col(c.fare) - F.col(c.distance) * F.col("_median_dev")
    masked = joined.select(
        REGIME, WEEKEND, HOUR, LAT_BIN, LON_BIN,
        (F.col(c.fare) - F.col(c.distance) * F.col(MEDIAN_RATE)).alias("_dev_b"),
        F.when(dev, dev_d).alias("_dev_d"), F.when(dev, F.abs(dev_d)).alias("_abs_d"),
        F.when(dev, F.lit(1)).otherwise(F.lit(0)).alias("_one_dev"),
        F.when(dec, F.lit(1)).otherwise(F.lit(0)).alias("_one_dec"),
        *[F.when(dec, F.col(x)).alias(f"_m_{x}") for x in ("fixed_fees", "tolls", "fixed_fee_share", "toll_share")],
    )
    sets: list[tuple[str, ...]] = []
    means, quantiles, reads = {}, {}, {}
    for n in rest:
        keys, _, some_means, some = _SCAN2[n]
        if keys not in sets:
            sets.append(keys)
        means.update(some_means)
        quantiles.update(some)
        cols = reads.setdefault(sets.index(keys), [])
        cols += [x for x in dict.fromkeys(x for x, _ in some.values()) if x not in cols]
    cells = {sets.index(R.CELL_KEYS): min_trips} if R.CELL_KEYS in sets else {}
    stats = group_stats_sets(
        masked, [list(k) for k in sets], count_as="_rows", sums={"_n_dev": "_one_dev", "_n_dec": "_one_dec"}, means=means,
        quantiles=quantiles, method=cfg.percentile_method, accuracy=cfg.percentile_accuracy, kll_k=cfg.kll_k,
        reads=reads, min_rows=cells)
    if persist:
        stats = stats.persist()
        cached.append(stats)

    for n in rest:
        keys, count, _, _ = _SCAN2[n]
        st = stats.filter(F.col(SET_COL) == F.lit(sets.index(keys))).drop(SET_COL)
        st = st.filter(F.col(count) > 0).withColumn("trips", F.col(count))
        if n == "regime_deviation_summary":
            out[n] = st.select(
                REGIME, "trips", F.round("_avg", 2).alias("avg_deviation"), F.round("_p50", 2).alias("median_deviation"),
                F.round("_p90", 2).alias("p90_deviation"), F.round("_p10", 2).alias("p10_deviation"),
            ).orderBy(REGIME)
        else:
            out[n] = R.finish(n, st, cfg, min_trips=min_trips)


def plan_reports(trips: DataFrame, cfg: FareConfig = DEFAULT, names: list[str] | None = None,
                 min_trips: int = MIN_GROUP_TRIPS, persist: bool = True) -> tuple[dict[str, DataFrame], list[DataFrame]]:
    """Report DataFrames sharing their scans; returns (reports, frames to unpersist).

    With ``persist`` the shared per-group statistics are cached for the
    reports that read them; without it each report recomputes its shared
    aggregate (for callers that use only one of the reports)."""
    names = list(REPORT_NAMES) if names is None else names
    out: dict[str, DataFrame] = {}
    cached: list[DataFrame] = []
    analytics = [n for n in names if n not in _FARE_REPORTS]
    fare = [n for n in names if n in _FARE_REPORTS]
    # scan 1: analytics reports, R5 and both regime baselines (GROUPING SETS over masked columns)
    sets: list[tuple[str, ...]] = []
    sums, means = {"_n_ana": "_one_ana", "_n_base": "_one_base"}, {}
    for n in analytics:
        spec = R.SPECS[n]
        if spec.keys not in sets:
            sets.append(spec.keys)
        sums.update(spec.sums)
        means.update(spec.means)
    quantiles = {}
    if fare:
        if (REGIME,) not in sets:
            sets.append((REGIME,))
        quantiles = {MEDIAN_RATE: ("_rate_b", P_MEDIAN), "_median_dev": ("_rate_dev", P_MEDIAN)}
    reads = {i: ["_rate_b", "_rate_dev"] if keys == (REGIME,) else [] for i, keys in enumerate(sets)}
    stats = group_stats_sets(first_pass_frame(trips, cfg), [list(k) for k in sets], sums=sums, means=means,
                             quantiles=quantiles, method=cfg.percentile_method, accuracy=cfg.percentile_accuracy,
                             kll_k=cfg.kll_k, reads=reads)
    if persist and len(analytics) + (1 if fare else 0) > 1:
        stats = stats.persist()
        cached.append(stats)

    def part(keys: tuple[str, ...], count: str) -> DataFrame:
        st = stats.filter(F.col(SET_COL) == F.lit(sets.index(keys))).drop(SET_COL)
        return st.filter(F.col(count) > 0).withColumn("trips", F.col(count))

    for n in analytics:
        out[n] = R.finish(n, part(R.SPECS[n].keys, "_n_ana"), cfg, min_trips=min_trips)
    if fare:
        baselines = part((REGIME,), "_n_base").select(REGIME, MEDIAN_RATE, "trips", "_median_dev")
        out["regime_baseline"] = baselines.select(REGIME, MEDIAN_RATE, "trips").orderBy(REGIME)
        if fare != ["regime_baseline"]:
            _fare_reports(trips, cfg, fare, min_trips, persist, out, cached, materialize(baselines, "baselines"))
    return {n: out[n] for n in names}, cached


def run_reports(trips: DataFrame, cfg: FareConfig = DEFAULT, names: list[str] | None = None,
                min_trips: int = MIN_GROUP_TRIPS, sink: Callable[[str, DataFrame], object] | None = None,
                parallelism: int = 4) -> dict[str, object]:
    """Compute the named reports (default: all). ``sink(name, df)`` receives each
    report (e.g. a CSV writer); by default the small report rows are collected."""
    frames, cached = plan_reports(trips, cfg, names, min_trips)

    def one(n: str) -> object:
        return sink(n, frames[n]) if sink else frames[n].collect()

    try:
        if parallelism <= 1:
            return {n: one(n) for n in frames}
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            futures = {n: pool.submit(one, n) for n in frames}
            return {n: f.result() for n, f in futures.items()}
    finally:
        for df in cached:
            df.unpersist()
