"""Row filters and the five named cleaning profiles.

A profile is one condition over raw columns, stated once: ``clean`` filters by
it (Catalyst pushes its comparisons into the Parquet scan) and the report
suite masks values with it.
The profiles differ on purpose (>= vs >, guards, bounds) and are kept apart.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewise.config import DEFAULT, FareConfig
from farewise.functions import duration_minutes, unit_rate, within_bbox as bbox_predicate

TRIP_MINUTES = "trip_minutes"
TRIP_DURATION_MINS = "trip_duration_mins"
FARE_PER_MILE = "fare_per_mile"


def require_not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    cond = None
    for c in cols:
        cond = F.col(c).isNotNull() if cond is None else cond & F.col(c).isNotNull()
    return df if cond is None else df.filter(cond)


def within_bbox(df: DataFrame, cfg: FareConfig = DEFAULT) -> DataFrame:
    """Keep pickups inside the inclusive box (drops (0, 0) and null coordinates)."""
    c = cfg.cols
    return df.filter(bbox_predicate(c.pickup_lat, c.pickup_lon, cfg.bbox_lat, cfg.bbox_lon))


def rate_guard(df: DataFrame, rate: str = FARE_PER_MILE, lo: float | None = None, hi: float | None = None,
               cfg: FareConfig = DEFAULT) -> DataFrame:
    lo = cfg.rate_guard[0] if lo is None else lo
    hi = cfg.rate_guard[1] if hi is None else hi
    return df.filter((F.col(rate) >= lo) & (F.col(rate) <= hi))


def drop_incomplete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows holding a null (or NaN) in any of ``cols`` (default: all)."""
    return df.dropna(how="any", subset=list(cols) if cols else None)


def with_fare_per_mile(df: DataFrame, cfg: FareConfig = DEFAULT) -> DataFrame:
    return df.withColumn(FARE_PER_MILE, unit_rate(cfg.cols.fare, cfg.cols.distance))


def _known(*cols: str) -> Column:
    return reduce(and_, [F.col(c).isNotNull() for c in cols])


def _analytics(cfg: FareConfig) -> Column:
    c = cfg.cols
    minutes = duration_minutes(c.pickup_ts, c.dropoff_ts)
    return (_known(c.pickup_ts, c.dropoff_ts, c.distance, c.total) & (F.col(c.distance) >= 0) & (F.col(c.total) >= 0)
            & (minutes > 0) & (minutes < cfg.max_trip_minutes))


def _baseline(cfg: FareConfig) -> Column:
    c = cfg.cols
    return _known(c.distance, c.fare) & (F.col(c.distance) > 0) & (F.col(c.fare) >= 0)


def _deviation(cfg: FareConfig) -> Column:
    c = cfg.cols
    rate = unit_rate(c.fare, c.distance)
    return (_known(c.distance, c.fare, c.pickup_ts) & (F.col(c.distance) > 0) & (F.col(c.fare) > 0)
            & (rate >= cfg.rate_guard[0]) & (rate <= cfg.rate_guard[1]))


def _decomposition(cfg: FareConfig) -> Column:
    c = cfg.cols
    return (_deviation(cfg) & _known(c.pickup_lat, c.pickup_lon)
            & bbox_predicate(c.pickup_lat, c.pickup_lon, cfg.bbox_lat, cfg.bbox_lon))


def _modelling(cfg: FareConfig) -> Column:
    c = cfg.cols
    minutes = duration_minutes(c.pickup_ts, c.dropoff_ts)
    return _decomposition(cfg) & _known(c.dropoff_ts) & (minutes > 0) & (minutes <= cfg.max_trip_minutes)


#: Profile -> (rows it keeps, names of the columns it adds).
PROFILES = {
    "analytics": (_analytics, (TRIP_MINUTES,)),
    "baseline": (_baseline, ()),
    "deviation": (_deviation, (FARE_PER_MILE,)),
    "decomposition": (_decomposition, (FARE_PER_MILE,)),
    "modelling": (_modelling, (FARE_PER_MILE, TRIP_DURATION_MINS)),
}


def _profile(profile: str):
    try:
        return PROFILES[profile]
    except KeyError:
        raise ValueError(f"unknown profile {profile!r}; choose from {sorted(PROFILES)}") from None


def profile_predicate(profile: str, cfg: FareConfig = DEFAULT) -> Column:
    """The rows that a profile keeps, as one condition (null where a compared value is null)."""
    return _profile(profile)[0](cfg)


def clean(df: DataFrame, profile: str, cfg: FareConfig = DEFAULT) -> DataFrame:
    """Apply a named cleaning profile.

    analytics      pickup, dropoff, distance, total not null; distance >= 0; total >= 0;
                   0 < trip_minutes < 180 (adds ``trip_minutes``)
    baseline       distance, fare not null; distance > 0; fare >= 0
    deviation      distance, fare, pickup not null; distance > 0; fare > 0;
                   0 <= fare_per_mile <= 50 (adds ``fare_per_mile``)
    decomposition  deviation + pickup coordinates inside the bounding box
    modelling      decomposition + dropoff not null; 0 < trip_duration_mins <= 180
                   (adds ``fare_per_mile``, ``trip_duration_mins``)
    """
    predicate, added = _profile(profile)
    c = cfg.cols
    derived = {FARE_PER_MILE: unit_rate(c.fare, c.distance), TRIP_MINUTES: duration_minutes(c.pickup_ts, c.dropoff_ts),
               TRIP_DURATION_MINS: duration_minutes(c.pickup_ts, c.dropoff_ts)}
    kept = df.filter(predicate(cfg))
    return kept.withColumns({name: derived[name] for name in added}) if added else kept
