"""DuckDB SQL that states each registered query independently of Spark.

The driver runs these on the same Parquet tables (pre-registered views) and
compares them with the Spark results. Building blocks:

* ``trips`` CTE: the test-data projection over ``events``;
* profile CTEs written out as plain WHERE clauses;
* ``_r(x, d)``: Spark's ROUND on a double (HALF_UP on the shortest decimal
  representation), which DuckDB's ROUND on a double does not do;
* ``fsum`` / ``favg``: plain sums and means of the doubles (compensated, so that their last digit holds too).
"""

from __future__ import annotations

from farewise.config import BBOX_LAT, BBOX_LON, PAYMENT_LABELS, PAYMENT_OTHER, RATE_GUARD, REGIME_EDGES, REGIME_LABELS
from farewise.sources.fixture import trips_sql

# Percentiles are stated exactly (quantile_disc); every percentile method of
# the Spark side is exact for groups of this size.


def _r(expr: str, digits: int) -> str:
    return f"round(cast(cast(({expr}) as varchar) as decimal(38,18)), {digits})::double"


def _msum(expr: str, digits: int = 2) -> str:
    return _r(f"fsum({expr})", digits)


def _mavg(expr: str, digits: int = 2) -> str:
    return _r(f"favg({expr})", digits)


def _secs(start: str, end: str) -> str:
    return f"(epoch_us({end}) // 1000000 - epoch_us({start}) // 1000000)"


_MINUTES = f"{_secs('tpep_pickup_datetime', 'tpep_dropoff_datetime')} / 60e0"
_HOUR = "cast(hour(tpep_pickup_datetime) as integer)"
_WEEKEND = "(strftime(tpep_pickup_datetime, '%a') in ('Sat', 'Sun'))"
_DOW = "strftime(tpep_pickup_datetime, '%a')"
_REGIME = (
    f"case when trip_distance <= {REGIME_EDGES[0]}e0 then '{REGIME_LABELS[0]}' "
    f"when trip_distance <= {REGIME_EDGES[1]}e0 then '{REGIME_LABELS[1]}' else '{REGIME_LABELS[2]}' end"
)
_BBOX = (
    f"pickup_latitude between {BBOX_LAT[0]}e0 and {BBOX_LAT[1]}e0 "
    f"and pickup_longitude between {BBOX_LON[0]}e0 and {BBOX_LON[1]}e0"
)
_GUARD = f"fare_per_mile >= {RATE_GUARD[0]}e0 and fare_per_mile <= {RATE_GUARD[1]}e0"
_LAT_BIN = _r("pickup_latitude", 2)
_LON_BIN = _r("pickup_longitude", 2)
_PAYMENT = "case " + " ".join(
    f"when payment_type = {code} then '{label}'" for code, label in PAYMENT_LABELS.items()
) + f" else '{PAYMENT_OTHER}' end"

TRIPS = f"trips AS (\n{trips_sql('events')}\n)"

# profile CTEs (each adds the derived columns its filter needs)
ANALYTICS = f"""analytics AS (
  SELECT * FROM (
    SELECT *, {_MINUTES} AS trip_minutes FROM trips
    WHERE tpep_pickup_datetime IS NOT NULL AND tpep_dropoff_datetime IS NOT NULL
      AND trip_distance IS NOT NULL AND total_amount IS NOT NULL
      AND trip_distance >= 0 AND total_amount >= 0
  ) WHERE trip_minutes > 0 AND trip_minutes < 180e0
)"""

BASELINE = """baseline AS (
  SELECT * FROM trips
  WHERE trip_distance IS NOT NULL AND fare_amount IS NOT NULL AND trip_distance > 0 AND fare_amount >= 0
)"""

DEVIATION = f"""deviation AS (
  SELECT * FROM (
    SELECT *, fare_amount / trip_distance AS fare_per_mile FROM trips
    WHERE trip_distance IS NOT NULL AND fare_amount IS NOT NULL AND tpep_pickup_datetime IS NOT NULL
      AND trip_distance > 0 AND fare_amount > 0
  ) WHERE {_GUARD}
)"""

DECOMPOSITION = f"""decomposition AS (
  SELECT * FROM (
    SELECT *, fare_amount / trip_distance AS fare_per_mile FROM trips
    WHERE tpep_pickup_datetime IS NOT NULL AND pickup_latitude IS NOT NULL AND pickup_longitude IS NOT NULL
      AND trip_distance > 0 AND fare_amount > 0 AND {_BBOX}
  ) WHERE {_GUARD}
)"""

MODELLING = f"""modelling AS (
  SELECT * FROM (
    SELECT *, fare_amount / trip_distance AS fare_per_mile, {_MINUTES} AS trip_duration_mins FROM trips
    WHERE trip_distance IS NOT NULL AND fare_amount IS NOT NULL AND tpep_pickup_datetime IS NOT NULL
      AND tpep_dropoff_datetime IS NOT NULL AND pickup_latitude IS NOT NULL AND pickup_longitude IS NOT NULL
      AND trip_distance > 0 AND fare_amount > 0 AND {_BBOX}
  ) WHERE {_GUARD} AND trip_duration_mins > 0 AND trip_duration_mins <= 180e0
)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join([TRIPS, *ctes]) + "\n"


ORACLE: dict[str, str] = {}

ORACLE["hourly_demand_revenue"] = _with(ANALYTICS) + f"""
SELECT {_HOUR} AS pickup_hour,
       count(*) AS total_trips,
       {_mavg('trip_distance')} AS avg_trip_distance_miles,
       {_r(f"sum({_secs('tpep_pickup_datetime', 'tpep_dropoff_datetime')}) / count(*) / 60e0", 2)}
         AS avg_trip_duration_mins,
       {_msum('total_amount')} AS total_revenue_usd
FROM analytics GROUP BY 1 ORDER BY 1
"""

_TRIP_COLS = ("trip_id, VendorID, tpep_pickup_datetime, tpep_dropoff_datetime, passenger_count, trip_distance, "
              "pickup_longitude, pickup_latitude, RateCodeID, store_and_fwd_flag, dropoff_longitude, dropoff_latitude, "
              "payment_type, fare_amount, extra, mta_tax, tip_amount, tolls_amount, improvement_surcharge, "
              "total_amount")
_DOUBLE_COLS = ("trip_distance", "pickup_longitude", "pickup_latitude", "dropoff_longitude", "dropoff_latitude",
                "fare_amount", "extra", "mta_tax", "tip_amount", "tolls_amount", "improvement_surcharge",
                "total_amount")
_RATE = "case when trip_distance <> 0 then fare_amount / trip_distance end"
_FIXED = "coalesce(extra, 0e0) + coalesce(mta_tax, 0e0) + coalesce(improvement_surcharge, 0e0)"
_TOLLS = "coalesce(tolls_amount, 0e0)"
_GRID = f"concat_ws('_', cast({_LAT_BIN} as varchar), cast({_LON_BIN} as varchar))"

# ---------------------------------------------------------------- sources, sinks, profiling

ORACLE["trips_projection"] = _with() + "SELECT * FROM trips"
ORACLE["parquet_roundtrip"] = ORACLE["trips_projection"]
# The fixture CSV writer gives every 37th trip a non-integer VendorID and every
# 41st a non-numeric fare (sources/fixture.py); the ingest reads every line and
# must reject exactly those.
_CSV_BAD = "(trip_id % 37 = 0 OR trip_id % 41 = 0)"
ORACLE["csv_ingest"] = _with() + f"SELECT * FROM trips WHERE NOT {_CSV_BAD}"
ORACLE["stream_ingest"] = ORACLE["csv_ingest"]
ORACLE["csv_ingest_counts"] = _with() + f"""
SELECT count(*) FILTER (WHERE NOT {_CSV_BAD}) AS kept, count(*) FILTER (WHERE {_CSV_BAD}) AS rejected FROM trips"""
ORACLE["ingest_report"] = _with() + f"""
SELECT count(*) AS rows,
       count(*) FILTER (WHERE trip_distance < 0) AS negative_trip_distance,
       count(*) FILTER (WHERE total_amount < 0) AS negative_total_amount,
       count(*) FILTER (WHERE passenger_count < 0) AS negative_passenger_count,
       20::integer AS columns
FROM trips WHERE NOT {_CSV_BAD}"""
ORACLE["csv_reject_reasons"] = _with() + f"""
SELECT trip_id, CASE WHEN trip_id % 37 = 0 AND trip_id % 41 = 0 THEN 'VendorID,fare_amount'
                     WHEN trip_id % 37 = 0 THEN 'VendorID' ELSE 'fare_amount' END AS reject_reasons
FROM trips WHERE {_CSV_BAD}"""
ORACLE["csv_reject_counts"] = _with() + """
SELECT 'VendorID' AS reason, count(*) AS lines FROM trips WHERE trip_id % 37 = 0 HAVING count(*) > 0
UNION ALL
SELECT 'fare_amount', count(*) FROM trips WHERE trip_id % 41 = 0 HAVING count(*) > 0"""
ORACLE["csv_headers"] = _with() + f"""
SELECT DISTINCT '{_TRIP_COLS.replace(", ", ",")}' AS header, true AS matches, NULL::integer AS first_difference FROM trips"""
ORACLE["csv_ingest_instants"] = _with() + f"""
SELECT trip_id, epoch_us(tpep_pickup_datetime) AS pickup_micros FROM trips WHERE NOT {_CSV_BAD}"""
ORACLE["preview_head"] = _with() + """
SELECT trip_id, tpep_pickup_datetime, trip_distance, total_amount FROM trips ORDER BY trip_id LIMIT 5"""
ORACLE["profile_shape"] = _with() + "SELECT count(*) AS rows, 20::integer AS columns FROM trips"
ORACLE["violation_counts"] = _with() + """
SELECT count(*) AS rows,
       count(*) FILTER (WHERE trip_distance < 0) AS negative_trip_distance,
       count(*) FILTER (WHERE total_amount < 0) AS negative_total_amount,
       count(*) FILTER (WHERE passenger_count < 0) AS negative_passenger_count
FROM trips"""

# ---------------------------------------------------------------- filters and profiles

ORACLE["bbox_filter"] = _with() + f"SELECT * FROM trips WHERE {_BBOX}"
ORACLE["clean_analytics"] = _with(ANALYTICS) + f"SELECT {_TRIP_COLS} FROM analytics"
ORACLE["clean_baseline"] = _with(BASELINE) + f"SELECT {_TRIP_COLS} FROM baseline"
ORACLE["clean_deviation"] = _with(DEVIATION) + f"SELECT {_TRIP_COLS} FROM deviation"
ORACLE["clean_decomposition"] = _with(DECOMPOSITION) + f"SELECT {_TRIP_COLS} FROM decomposition"
ORACLE["clean_modelling"] = _with(MODELLING) + f"SELECT {_TRIP_COLS} FROM modelling"
ORACLE["rate_guard"] = _with() + f"""
SELECT trip_id, fare_per_mile FROM (SELECT trip_id, {_RATE} AS fare_per_mile FROM trips)
WHERE {_GUARD}"""
ORACLE["drop_incomplete"] = _with() + "SELECT * FROM trips WHERE " + " AND ".join(
    [f"{c} IS NOT NULL" for c in _TRIP_COLS.split(", ")] + [f"NOT isnan({c})" for c in _DOUBLE_COLS])

# ---------------------------------------------------------------- scalar features

ORACLE["trip_minutes"] = _with() + f"SELECT trip_id, {_MINUTES} AS trip_minutes FROM trips"
ORACLE["calendar_features"] = _with() + f"""
SELECT trip_id, {_HOUR} AS pickup_hour, cast(tpep_pickup_datetime AS date) AS pickup_date,
       {_DOW} AS pickup_dow, {_WEEKEND} AS is_weekend
FROM trips"""
ORACLE["payment_label"] = _with() + f"SELECT trip_id, payment_type, {_PAYMENT} AS payment_label FROM trips"
ORACLE["grid_bins"] = _with() + f"""
SELECT trip_id, {_LAT_BIN} AS pickup_lat_bin, {_LON_BIN} AS pickup_lon_bin, {_GRID} AS pickup_grid FROM trips"""
ORACLE["distance_regime"] = _with() + f"SELECT trip_id, trip_distance, {_REGIME} AS distance_regime FROM trips"
ORACLE["unit_rate"] = _with() + f"SELECT trip_id, {_RATE} AS fare_per_mile FROM trips"
ORACLE["fare_components"] = _with() + f"""
SELECT trip_id, fixed_fees, tolls,
       case when fare_amount <> 0 then fixed_fees / fare_amount end AS fixed_fee_share,
       case when fare_amount <> 0 then tolls / fare_amount end AS toll_share
FROM (SELECT trip_id, fare_amount, {_FIXED} AS fixed_fees, {_TOLLS} AS tolls FROM trips)"""

# deviation profile with features, the regime baseline and every trip's deviation
_DEV_FEATURES = f"""dev_f AS (
  SELECT *, {_REGIME} AS distance_regime, {_HOUR} AS pickup_hour, {_WEEKEND} AS is_weekend,
         {_LAT_BIN} AS pickup_lat_bin, {_LON_BIN} AS pickup_lon_bin
  FROM deviation
),
dev_stats AS (
  SELECT distance_regime, quantile_disc(fare_per_mile, 0.5) AS median_fare_per_mile FROM dev_f GROUP BY 1
),
dev AS (
  SELECT *, fare_amount - expected_fare_baseline AS fare_deviation,
         abs(fare_amount - expected_fare_baseline) AS abs_deviation
  FROM (SELECT f.*, s.median_fare_per_mile, f.trip_distance * s.median_fare_per_mile AS expected_fare_baseline
        FROM dev_f f LEFT JOIN dev_stats s USING (distance_regime))
)"""
ORACLE["baseline_deviation"] = _with(DEVIATION, _DEV_FEATURES) + """
SELECT trip_id, distance_regime, median_fare_per_mile, expected_fare_baseline, fare_deviation, abs_deviation
FROM dev"""

# ---------------------------------------------------------------- group statistics on lineitem

_LI_RATES = """rates AS (
  SELECT l_returnflag, l_linestatus,
         case when l_quantity <> 0 then l_extendedprice / l_quantity end AS unit_price
  FROM lineitem
)"""
ORACLE["group_percentiles"] = f"WITH {_LI_RATES}\n" + """
SELECT l_returnflag, l_linestatus, count(*) AS items,
       quantile_disc(unit_price, 0.1) AS p10_unit_price,
       quantile_disc(unit_price, 0.5) AS p50_unit_price,
       quantile_disc(unit_price, 0.9) AS p90_unit_price
FROM rates GROUP BY 1, 2"""
ORACLE["lineitem_price_deviation"] = f"WITH {_LI_RATES},\n" + f"""
stats AS (SELECT l_returnflag, l_linestatus, quantile_disc(unit_price, 0.5) AS median_unit_price
          FROM rates GROUP BY 1, 2),
j AS (
  SELECT r.*, abs(r.unit_price - s.median_unit_price) AS dev,
         case when r.unit_price <= 1000e0 then 'low' when r.unit_price <= 1500e0 then 'mid' else 'high' end
           AS size_band
  FROM rates r LEFT JOIN stats s
    ON r.l_returnflag IS NOT DISTINCT FROM s.l_returnflag AND r.l_linestatus IS NOT DISTINCT FROM s.l_linestatus
)
SELECT l_returnflag, l_linestatus, size_band, count(*) AS items,
       {_r("avg(dev)", 4)} AS avg_abs_dev, {_r("max(dev)", 4)} AS max_abs_dev
FROM j GROUP BY 1, 2, 3"""

# ---------------------------------------------------------------- reports

ORACLE["weekend_vs_weekday_hourly"] = _with(ANALYTICS) + f"""
SELECT {_WEEKEND} AS is_weekend, {_HOUR} AS pickup_hour, count(*) AS trips,
       {_mavg('total_amount')} AS avg_total_amount_usd
FROM analytics GROUP BY 1, 2"""
ORACLE["payment_split"] = _with(ANALYTICS) + f"""
SELECT {_PAYMENT} AS payment_label, count(*) AS trips,
       {_msum('total_amount')} AS revenue_usd,
       {_mavg('tip_amount')} AS avg_tip_usd
FROM analytics GROUP BY 1"""
ORACLE["report_csv_roundtrip"] = ORACLE["payment_split"]
ORACLE["top_pickup_grids"] = _with(ANALYTICS) + f"""
SELECT {_LAT_BIN} AS pickup_lat_bin, {_LON_BIN} AS pickup_lon_bin, count(*) AS trips,
       {_mavg('total_amount')} AS avg_total_amount_usd
FROM analytics WHERE {_BBOX}
GROUP BY 1, 2 ORDER BY trips DESC, 1 ASC NULLS FIRST, 2 ASC NULLS FIRST LIMIT 50"""

_BASE_FEATURES = f"""base_f AS (
  SELECT *, {_REGIME} AS distance_regime, fare_amount / trip_distance AS fare_per_mile FROM baseline
),
base_stats AS (
  SELECT distance_regime, quantile_disc(fare_per_mile, 0.5) AS median_fare_per_mile, count(*) AS trips
  FROM base_f GROUP BY 1
)"""
ORACLE["regime_baseline"] = _with(BASELINE, _BASE_FEATURES) + "SELECT * FROM base_stats"
ORACLE["regime_deviation_summary"] = _with(BASELINE, _BASE_FEATURES) + f""",
d AS (SELECT f.distance_regime, f.fare_amount - f.trip_distance * s.median_fare_per_mile AS fare_deviation
      FROM base_f f LEFT JOIN base_stats s USING (distance_regime))
SELECT distance_regime, count(*) AS trips,
       {_r("avg(fare_deviation)", 2)} AS avg_deviation,
       {_r("quantile_disc(fare_deviation, 0.5)", 2)} AS median_deviation,
       {_r("quantile_disc(fare_deviation, 0.9)", 2)} AS p90_deviation,
       {_r("quantile_disc(fare_deviation, 0.1)", 2)} AS p10_deviation
FROM d GROUP BY 1"""
ORACLE["deviation_by_time"] = _with(DEVIATION, _DEV_FEATURES) + f"""
SELECT distance_regime, is_weekend, pickup_hour, count(*) AS trips,
       {_r("quantile_disc(abs_deviation, 0.5)", 2)} AS median_abs_dev,
       {_r("quantile_disc(abs_deviation, 0.9)", 2)} AS p90_abs_dev,
       {_r("avg(fare_deviation)", 2)} AS avg_dev
FROM dev GROUP BY 1, 2, 3"""


def _top_grids(min_trips: int, k: int = 100) -> str:
    return _with(DEVIATION, _DEV_FEATURES) + f"""
SELECT * FROM (
  SELECT distance_regime, pickup_lat_bin, pickup_lon_bin, count(*) AS trips,
         {_r("quantile_disc(abs_deviation, 0.9)", 2)} AS p90_abs_dev,
         {_r("quantile_disc(abs_deviation, 0.5)", 2)} AS median_abs_dev
  FROM dev GROUP BY 1, 2, 3
) WHERE trips >= {min_trips}
ORDER BY p90_abs_dev DESC, distance_regime ASC NULLS FIRST, pickup_lat_bin ASC NULLS FIRST,
         pickup_lon_bin ASC NULLS FIRST
LIMIT {k}"""


ORACLE["deviation_top_grids"] = _top_grids(20)

_DECOMP_FEATURES = f"""dec_f AS (
  SELECT *, fixed_fees / fare_amount AS fixed_fee_share, tolls / fare_amount AS toll_share FROM (
    SELECT *, {_REGIME} AS distance_regime, {_HOUR} AS pickup_hour, {_WEEKEND} AS is_weekend,
           {_LAT_BIN} AS pickup_lat_bin, {_LON_BIN} AS pickup_lon_bin,
           {_FIXED} AS fixed_fees, {_TOLLS} AS tolls
    FROM decomposition)
)"""
ORACLE["decomposition_by_time"] = _with(DECOMPOSITION, _DECOMP_FEATURES) + f"""
SELECT distance_regime, is_weekend, pickup_hour, count(*) AS trips,
       {_r("quantile_disc(fixed_fees, 0.5)", 2)} AS median_fixed_fees,
       {_r("quantile_disc(tolls, 0.5)", 2)} AS median_tolls,
       {_r("quantile_disc(fixed_fee_share, 0.5)", 3)} AS median_fixed_fee_share,
       {_r("quantile_disc(toll_share, 0.9)", 3)} AS p90_toll_share
FROM dec_f GROUP BY 1, 2, 3"""
ORACLE["toll_heavy_grids"] = _with(DECOMPOSITION, _DECOMP_FEATURES) + f"""
SELECT * FROM (
  SELECT distance_regime, pickup_lat_bin, pickup_lon_bin, count(*) AS trips,
         {_r("quantile_disc(tolls, 0.5)", 2)} AS median_tolls,
         {_r("quantile_disc(tolls, 0.9)", 2)} AS p90_tolls
  FROM dec_f GROUP BY 1, 2, 3
) WHERE trips >= 20
ORDER BY p90_tolls DESC, distance_regime ASC NULLS FIRST, pickup_lat_bin ASC NULLS FIRST,
         pickup_lon_bin ASC NULLS FIRST
LIMIT 100"""

# ---------------------------------------------------------------- modelling

_TOP_N = 10


def _hash_unit(salt: str, seed: int = 42) -> str:
    return f"(('0x' || substr(md5('{salt}:{seed}:' || cast(trip_id AS varchar)), 1, 8))::BIGINT / 4294967296e0)"


_ML = f"""m_f AS (
  SELECT *, {_GRID} AS pickup_grid FROM (
    SELECT *, {_HOUR} AS pickup_hour, {_WEEKEND} AS is_weekend,
           {_LAT_BIN} AS pickup_lat_bin, {_LON_BIN} AS pickup_lon_bin,
           {_FIXED} AS fixed_fees, {_TOLLS} AS tolls, {_REGIME} AS distance_regime
    FROM modelling)
),
top_cells AS (
  SELECT pickup_grid FROM m_f WHERE pickup_grid IS NOT NULL GROUP BY 1
  ORDER BY count(*) DESC, pickup_grid ASC LIMIT {_TOP_N}
),
m_top AS (
  SELECT m_f.*, coalesce(t.pickup_grid, 'other') AS pickup_grid_top
  FROM m_f LEFT JOIN top_cells t ON m_f.pickup_grid = t.pickup_grid
),
ds AS (
  SELECT trip_id, fare_amount AS label_fare_amount, trip_distance, pickup_hour, is_weekend, RateCodeID,
         pickup_grid_top, fixed_fees, tolls, trip_duration_mins, fare_per_mile, distance_regime
  FROM m_top
  WHERE RateCodeID IS NOT NULL AND is_weekend IS NOT NULL AND pickup_hour IS NOT NULL
    AND NOT isnan(fare_amount) AND NOT isnan(trip_distance) AND NOT isnan(fixed_fees) AND NOT isnan(tolls)
    AND NOT isnan(trip_duration_mins) AND NOT isnan(fare_per_mile)
),
split AS (SELECT *, {_hash_unit('split')} < 0.2e0 AS is_test FROM ds),
coef AS (
  SELECT regr_slope(label_fare_amount, trip_distance) AS slope,
         regr_intercept(label_fare_amount, trip_distance) AS intercept,
         regr_count(label_fare_amount, trip_distance)::BIGINT AS n_train
  FROM split WHERE NOT is_test
),
pred AS (
  SELECT s.*, c.intercept + c.slope * s.trip_distance AS y_pred_model0,
         abs(s.label_fare_amount - (c.intercept + c.slope * s.trip_distance)) AS abs_err_model0
  FROM split s, coef c WHERE s.is_test
)"""

ORACLE["ml_fare_dataset"] = _with(MODELLING, _ML) + "SELECT * FROM ds"
ORACLE["topn_or_other"] = _with(MODELLING, _ML) + "SELECT trip_id, pickup_grid, pickup_grid_top FROM m_top"
ORACLE["topn_or_other_skewed"] = f"""
WITH keyed AS (
  SELECT l_orderkey, l_linenumber,
         cast(CASE WHEN l_orderkey % 3 = 0 THEN -(l_suppkey % {_TOP_N}) - 1 ELSE l_orderkey END AS varchar) AS skewed_key
  FROM lineitem
),
top AS (SELECT skewed_key AS k FROM keyed GROUP BY 1 ORDER BY count(*) DESC, skewed_key LIMIT {_TOP_N // 2})
SELECT l_orderkey, l_linenumber, skewed_key, coalesce(k, 'other') AS skewed_key_top
FROM keyed LEFT JOIN top ON skewed_key = k"""
ORACLE["hash_sample"] = _with(MODELLING, _ML) + f"""
SELECT trip_id, label_fare_amount FROM ds WHERE {_hash_unit('sample')} < 0.1e0"""
ORACLE["holdout_split"] = _with(MODELLING, _ML) + "SELECT trip_id, is_test FROM split"
ORACLE["linear_fit"] = _with(MODELLING, _ML) + f"""
SELECT {_r("slope", 6)} AS slope, {_r("intercept", 6)} AS intercept, n_train FROM coef"""
ORACLE["linear_predictions"] = _with(MODELLING, _ML) + f"""
SELECT trip_id, label_fare_amount AS y_true, {_r("y_pred_model0", 6)} AS y_pred_model0 FROM pred"""
ORACLE["linear_metrics"] = _with(MODELLING, _ML) + f"""
SELECT 'Model0_DistanceOnly_LinearRegression' AS model, 1.0e0 AS sample_frac,
       {_r("avg(abs_err_model0)", 6)} AS MAE,
       {_r("sqrt(avg((label_fare_amount - y_pred_model0) * (label_fare_amount - y_pred_model0)))", 6)} AS RMSE
FROM pred"""
ORACLE["linear_residuals"] = _with(MODELLING, _ML) + f"""
SELECT trip_id, label_fare_amount AS y_true, {_r("y_pred_model0", 6)} AS y_pred_model0, trip_distance,
       pickup_hour, is_weekend, {_r("abs_err_model0", 6)} AS abs_err_model0
FROM pred"""
ORACLE["residuals_overall"] = _with(MODELLING, _ML) + f"""
SELECT 'Distance-only' AS model, {_r("avg(abs_err_model0)", 6)} AS avg_abs_error FROM pred"""
ORACLE["residuals_by_hour"] = _with(MODELLING, _ML) + f"""
SELECT pickup_hour, {_r("avg(abs_err_model0)", 6)} AS abs_err_model0 FROM pred GROUP BY 1"""
ORACLE["residuals_by_weekend"] = _with(MODELLING, _ML) + f"""
SELECT is_weekend, {_r("avg(abs_err_model0)", 6)} AS abs_err_model0 FROM pred GROUP BY 1"""
ORACLE["residuals_by_regime"] = _with(MODELLING, _ML) + f"""
SELECT {_REGIME} AS distance_regime, {_r("avg(abs_err_model0)", 6)} AS abs_err_model0 FROM pred GROUP BY 1"""

# exact-percentile variants state the same result
for _name in ("group_percentiles", "deviation_by_time", "regime_deviation_summary", "decomposition_by_time"):
    ORACLE[f"{_name}_exact"] = ORACLE[_name]
for _name in ("group_percentiles", "regime_baseline", "deviation_by_time", "decomposition_by_time"):
    ORACLE[f"{_name}_bracket"] = ORACLE[_name]
for _name in ("group_percentiles", "deviation_by_time"):
    ORACLE[f"{_name}_sketch"] = ORACLE[_name]

# the report suite computes the same reports from two GROUPING SETS scans
for _name in ("hourly_demand_revenue", "weekend_vs_weekday_hourly", "payment_split", "top_pickup_grids",
              "regime_baseline", "regime_deviation_summary", "deviation_by_time", "deviation_top_grids",
              "decomposition_by_time", "toll_heavy_grids"):
    ORACLE[f"suite_{_name}"] = ORACLE[_name]

# The analytics reports over odd amounts (catalog.odd_amounts): plain sums and means where a group holds NaN or an
# infinity, compensated ones elsewhere; doubles told apart as catalog.told_apart does.
_ODD = """odd AS (
  SELECT * REPLACE (
    CASE WHEN trip_id % 499 = 1 THEN 'nan'::double WHEN trip_id % 503 = 2 THEN 'inf'::double WHEN trip_id % 101 = 3 THEN 1e16
         WHEN trip_id % 5 = 0 THEN 4e-5 ELSE total_amount END AS total_amount,
    CASE WHEN trip_id % 997 = 4 THEN '-inf'::double WHEN trip_id % 7 = 0 THEN 4e-5 ELSE tip_amount END AS tip_amount)
  FROM trips
)"""
_ODD_COLS = {
    "hourly_demand_revenue": ("pickup_hour, total_trips", ("avg_trip_distance_miles", "avg_trip_duration_mins", "total_revenue_usd")),
    "weekend_vs_weekday_hourly": ("is_weekend, pickup_hour, trips", ("avg_total_amount_usd",)),
    "payment_split": ("payment_label, trips", ("revenue_usd", "avg_tip_usd")),
    "top_pickup_grids": ("pickup_lat_bin, pickup_lon_bin, trips", ("avg_total_amount_usd",)),
}


def _odd(name: str) -> str:
    sql = ORACLE[name].replace("FROM trips\n    WHERE tpep", "FROM odd\n    WHERE tpep").replace("analytics AS (", _ODD + ",\nanalytics AS (", 1)
    for measure in ("total_amount", "tip_amount"):
        for kahan, plain in (("fsum", "sum"), ("favg", "avg")):
            for digits in (2,):
                sql = sql.replace(_r(f"{kahan}({measure})", digits),
                                  f"CASE WHEN isfinite({plain}({measure})) THEN {_r(f'{kahan}({measure})', digits)} "
                                  f"ELSE {plain}({measure}) END")
    keys, values = _ODD_COLS[name]
    told = ", ".join(f"CASE WHEN isnan({v}) THEN 'nan' WHEN {v} = 'inf'::double THEN 'inf' WHEN {v} = '-inf'::double THEN '-inf' "
                     f"WHEN {v} IS NOT NULL THEN 'number' END AS {v}_is, CASE WHEN isfinite({v}) THEN CASE WHEN abs({v}) < 1e12 THEN {v} ELSE round({v} / 10000e0) * 10000e0 END END AS {v}" for v in values)
    return f"SELECT {keys}, {told} FROM (\n{sql}\n)"


for _name in _ODD_COLS:
    ORACLE[f"{_name}_odd"] = ORACLE[f"suite_{_name}_odd"] = _odd(_name)

# One-hot features of the test rows: categories of the training rows by falling frequency, then by label.
_CATEGORIES = {"is_weekend": "cast(is_weekend as varchar)", "RateCodeID": "cast(RateCodeID as varchar)", "pickup_grid_top": "pickup_grid_top"}
_ONE_HOT = ",\n".join(
    f"{c}_codes AS (SELECT list(label ORDER BY n DESC, label) AS labels FROM "
    f"(SELECT {x} AS label, count(*) AS n FROM split WHERE NOT is_test GROUP BY 1))" for c, x in _CATEGORIES.items())
ORACLE["one_hot_features"] = _with(MODELLING, _ML, _ONE_HOT) + f"""
SELECT trip_id, list_concat(
  [trip_distance::double, pickup_hour::double, fixed_fees::double, tolls::double, trip_duration_mins::double], """ + \
    "list_concat(" + ", ".join([", ".join(
        f"(SELECT list_transform(labels, lambda l: case when l = {x} then 1e0 else 0e0 end) FROM {c}_codes)"
        for c, x in list(_CATEGORIES.items())[:1])]) + ", list_concat(" + ", ".join(
        f"(SELECT list_transform(labels, lambda l: case when l = {x} then 1e0 else 0e0 end) FROM {c}_codes)"
        for c, x in list(_CATEGORIES.items())[1:]) + """))) AS features
FROM split WHERE is_test
"""
