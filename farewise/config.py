"""Column names, domain constants and the raw trip schema.

Every operator takes its constants from a ``FareConfig`` so it works on any
trip-like table; the defaults are the values the published analysis used.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# --- fixed values (must equal the published analysis for identical results) ---
# City bounding box, inclusive: latitude 40.5 .. 41.0, longitude -74.5 .. -73.5
BBOX_LAT = (40.5, 41.0)
BBOX_LON = (-74.5, -73.5)
# Grid resolution: coordinates rounded to 2 decimals
GRID_DIGITS = 2
# Distance regimes, right-closed: <= 1 short, (1, 5] medium, > 5 long
REGIME_EDGES = (1.0, 5.0)
REGIME_LABELS = ("short", "medium", "long")
# Fare-per-mile outlier guard, inclusive: 0 .. 50
RATE_GUARD = (0.0, 50.0)
# Trip duration bounds in minutes: (0, 180) for analytics, (0, 180] for modelling
MAX_TRIP_MINUTES = 180.0
# Minimum trips per group in the grid reports, and report limits
MIN_GROUP_TRIPS = 5000
TOP_PICKUP_GRIDS = 50
TOP_DEVIATION_GRIDS = 100
TOP_TOLL_GRIDS = 100
TOP_N_CATEGORIES = 300
# Percentile levels used by the reports
P_MEDIAN, P_HIGH, P_LOW = 0.5, 0.9, 0.1
# Sample fraction, test share and seed of the modelling step
SAMPLE_FRACTION = 0.01
TEST_FRACTION = 0.2
SEED = 42
# Payment codes: 1 Credit Card, 2 Cash, 3 No Charge, 4 Dispute, 5 Unknown, 6 Voided, else Other
PAYMENT_LABELS = {
    1: "Credit Card",
    2: "Cash",
    3: "No Charge",
    4: "Dispute",
    5: "Unknown",
    6: "Voided",
}
PAYMENT_OTHER = "Other"
# Weekend day names as produced by date_format(ts, 'E')
WEEKEND_DAYS = ("Sat", "Sun")
# Model names in the metrics table
LINEAR_MODEL_NAME = "Model0_DistanceOnly_LinearRegression"
FOREST_MODEL_NAME = "Model1_ContextAware_RandomForest+Duration"
# Residual report labels
LINEAR_REPORT_NAME = "Distance-only"
FOREST_REPORT_NAME = "Context-aware RF"
# --- end of fixed values ---

# Percentiles (see operators/quantiles.py): "digits" (exact and repeatable at any size: three scans of hash aggregates
# select the value digit by digit), "bracket" (the same result in two scans with sketches), "kll" (the sketches alone, one scan; exact below ~k rows
# per group, random beyond), "sketch" (percentile_approx; exact below ~accuracy / 2 rows) or "exact"
# (distributed rank selection over all distinct values).
# A KLL buffer holds about k doubles: k = 16384 is ~128 KB per group buffer, with rank error of order 1e-4.
PERCENTILE_METHOD = "digits"
KLL_K = 16384
PERCENTILE_ACCURACY = 1_000_000


@dataclass(frozen=True)
class TripColumns:
    pickup_ts: str = "tpep_pickup_datetime"
    dropoff_ts: str = "tpep_dropoff_datetime"
    distance: str = "trip_distance"
    fare: str = "fare_amount"
    total: str = "total_amount"
    tip: str = "tip_amount"
    extra: str = "extra"
    mta_tax: str = "mta_tax"
    surcharge: str = "improvement_surcharge"
    tolls: str = "tolls_amount"
    passengers: str = "passenger_count"
    payment: str = "payment_type"
    rate_code: str = "RateCodeID"
    pickup_lat: str = "pickup_latitude"
    pickup_lon: str = "pickup_longitude"


@dataclass(frozen=True)
class FareConfig:
    cols: TripColumns = field(default_factory=TripColumns)
    bbox_lat: tuple[float, float] = BBOX_LAT
    bbox_lon: tuple[float, float] = BBOX_LON
    grid_digits: int = GRID_DIGITS
    regime_edges: tuple[float, ...] = REGIME_EDGES
    regime_labels: tuple[str, ...] = REGIME_LABELS
    rate_guard: tuple[float, float] = RATE_GUARD
    max_trip_minutes: float = MAX_TRIP_MINUTES
    percentile_accuracy: int = PERCENTILE_ACCURACY
    percentile_method: str = PERCENTILE_METHOD
    kll_k: int = KLL_K


DEFAULT = FareConfig()

# 19-column raw trip schema (CSV is positional under an explicit schema).
TRIP_FIELDS = [
    ("VendorID", T.IntegerType()),
    ("tpep_pickup_datetime", T.TimestampNTZType()),
    ("tpep_dropoff_datetime", T.TimestampNTZType()),
    ("passenger_count", T.IntegerType()),
    ("trip_distance", T.DoubleType()),
    ("pickup_longitude", T.DoubleType()),
    ("pickup_latitude", T.DoubleType()),
    ("RateCodeID", T.IntegerType()),
    ("store_and_fwd_flag", T.StringType()),
    ("dropoff_longitude", T.DoubleType()),
    ("dropoff_latitude", T.DoubleType()),
    ("payment_type", T.IntegerType()),
    ("fare_amount", T.DoubleType()),
    ("extra", T.DoubleType()),
    ("mta_tax", T.DoubleType()),
    ("tip_amount", T.DoubleType()),
    ("tolls_amount", T.DoubleType()),
    ("improvement_surcharge", T.DoubleType()),
    ("total_amount", T.DoubleType()),
]

TRIP_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in TRIP_FIELDS])


def trip_schema(with_key: str | None = None, timestamp_type: T.DataType | None = None) -> T.StructType:
    """The raw trip schema, optionally with a leading row key and another timestamp type."""
    fields = []
    if with_key:
        fields.append(T.StructField(with_key, T.LongType(), True))
    for name, dtype in TRIP_FIELDS:
        if timestamp_type is not None and isinstance(dtype, T.TimestampNTZType):
            dtype = timestamp_type
        fields.append(T.StructField(name, dtype, True))
    return T.StructType(fields)
