"""Scans and sinks."""

from farewise.sources.fixture import TRIP_KEY, load_trips, table_path, trips_from_events, trips_sql, trips_table

__all__ = ["TRIP_KEY", "load_trips", "table_path", "trips_from_events", "trips_sql", "trips_table"]
