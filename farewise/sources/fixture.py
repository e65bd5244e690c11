"""Trip table derived from the driver's ``events`` table.

The test data holds no taxi trips, so a deterministic projection turns each
event into one 19-column trip (plus ``trip_id``). The expressions are plain
SQL that Spark and DuckDB evaluate identically; the oracle queries reuse the
same text as a leading CTE. Literals are written ``…e0`` so both engines use
doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: the trips projection over events ---
_INNER = {
    "d": "case when event_id % 97 = 0 then null when event_id % 89 = 0 then -1e0 "
         "else cast((event_id * 7919) % 1500 as double) / 100e0 end",
    "f": "case when event_id % 103 = 0 then null when event_id % 107 = 0 then -2.5e0 "
         "else 2.5e0 + cast((event_id * 7919) % 1500 as double) / 40e0 + value / 10e0 end",
    "x": "case when event_id % 13 = 0 then null when hour(ts) >= 20 or hour(ts) < 6 then 0.5e0 "
         "when hour(ts) >= 16 then 1e0 else 0e0 end",
    "m": "0.5e0",
    "t": "case when event_id % 17 = 0 then null when event_id % 8 = 0 then 5.33e0 else 0e0 end",
    "i": "case when event_id % 11 = 0 then null else 0.3e0 end",
}

_OUTER = {
    "trip_id": "event_id",
    "VendorID": "cast(user_id % 2 + 1 as int)",
    "tpep_pickup_datetime": "case when event_id % 211 = 0 then null else ts end",
    "tpep_dropoff_datetime": "case when event_id % 223 = 0 then null "
                             "else ts + cast((event_id * 37) % 11400 - 200 as int) * interval '1' second end",
    "passenger_count": "cast(case when event_id % 61 = 0 then -1 else event_id % 7 end as int)",
    "trip_distance": "d",
    "pickup_longitude": "case when event_id % 59 = 0 then 0e0 "
                        "else -74.0e0 + cast((user_id * 7) % 15 as double) / 100e0 + 0.0011e0 end",
    "pickup_latitude": "case when event_id % 59 = 0 then 0e0 when event_id % 199 = 0 then null "
                       "else 40.6e0 + cast(user_id % 12 as double) / 50e0 + 0.0012e0 end",
    "RateCodeID": "cast(case when event_id % 101 = 0 then null else 1 + user_id % 6 end as int)",
    "store_and_fwd_flag": "case when event_id % 43 = 0 then 'Y' else 'N' end",
    "dropoff_longitude": "-74.0e0 + cast((user_id * 11) % 15 as double) / 100e0 + 0.0011e0",
    "dropoff_latitude": "40.6e0 + cast((user_id * 5) % 12 as double) / 50e0 + 0.0012e0",
    "payment_type": "cast(case event_type when 'click' then 1 when 'view' then 2 when 'signup' then 3 "
                    "when 'error' then 4 else case user_id % 3 when 0 then 5 when 1 then 6 else null end end as int)",
    "fare_amount": "f",
    "extra": "x",
    "mta_tax": "m",
    "tip_amount": "case when event_type = 'click' then round(value / 10e0, 4) else 0e0 end",
    "tolls_amount": "t",
    "improvement_surcharge": "i",
    "total_amount": "case when event_id % 83 = 0 then null "
                    "else f + coalesce(x,0e0) + coalesce(m,0e0) + coalesce(t,0e0) + coalesce(i,0e0) end",
}
# --- end of fixed values ---

TRIP_KEY = "trip_id"


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def trips_from_events(events: DataFrame) -> DataFrame:
    """Project ``events`` to the trip schema, one trip per event (narrow, no shuffle)."""
    inner = events.select(
        "event_id", "ts", "user_id", "event_type", "value",
        *[F.expr(e).alias(n) for n, e in _INNER.items()],
    )
    return inner.select(*[F.expr(e).alias(n) for n, e in _OUTER.items()])


def load_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projection itself (lazy; recomputed by every query that reads it)."""
    return trips_from_events(spark.read.parquet(table_path(sf_dir, "events")))


_TABLES: dict[tuple, str] = {}


def trips_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trips of ``sf_dir`` as a Parquet table, like the processed table the reports read.

    Written once per application into the shared checkpoint folder and keyed
    by the events file, so later queries scan compact Parquet (profile filters
    reach the reader as pushed filters) instead of re-deriving every column.
    """
    from farewise.session import path_exists, path_stamp, scratch_path
    from farewise.sources.parquet import write_parquet

    key = (*path_stamp(spark, table_path(sf_dir, "events")), spark.sparkContext.applicationId)
    path = _TABLES.get(key)
    if path is None or not path_exists(spark, f"{path}/_SUCCESS"):  # a scratch folder may have been removed meanwhile
        path = write_parquet(load_trips(spark, sf_dir), scratch_path(spark, "trips"))
        _TABLES[key] = path
    return spark.read.parquet(path)


def trips_sql(source: str = "events") -> str:
    """The same projection as SQL text, for a leading CTE of an oracle query."""
    inner = ",\n    ".join(f"{e} AS {n}" for n, e in _INNER.items())
    outer = ",\n  ".join(f"{e} AS {n}" for n, e in _OUTER.items())
    return (
        f"SELECT\n  {outer}\nFROM (\n  SELECT event_id, ts, user_id, event_type, value,\n    {inner}\n"
        f"  FROM {source}\n) AS ev"
    )


# --- fixed values: malformed cells written into the fixture CSV ---
BAD_INT_EVERY = 37      # VendorID written as "x"
BAD_DOUBLE_EVERY = 41   # fare_amount written as "bad"
# --- end of fixed values ---


def write_trips_csv(trips: DataFrame, path: str, with_key: bool = True) -> str:
    """Write trips as multi-part CSV with a header, some lines carrying unparsable cells.

    Every cell is rendered as text by Spark (timestamps with microseconds);
    lines of every 37th trip get a non-integer VendorID and of every 41st a
    non-numeric fare, so an ingest must reject exactly those. Without the key
    the file has the 19 raw columns.
    """
    from pyspark.sql import types as T

    from farewise.sources.csv import TS_WRITE_FORMAT

    key = F.col(TRIP_KEY)
    cols = []
    for f in trips.schema.fields:
        c = F.col(f.name)
        text = F.date_format(c, TS_WRITE_FORMAT) if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)) \
            else c.cast("string")
        if f.name == "VendorID":
            text = F.when(key % BAD_INT_EVERY == 0, F.lit("x")).otherwise(text)
        elif f.name == "fare_amount":
            text = F.when(key % BAD_DOUBLE_EVERY == 0, F.lit("bad")).otherwise(text)
        if with_key or f.name != TRIP_KEY:
            cols.append(text.alias(f.name))
    trips.select(*cols).write.mode("overwrite").option("header", True).csv(path)
    return path
