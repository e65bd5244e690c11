"""farewise: trip-fare analytics as composable Spark DataFrame operators.

Layout
  functions/  scalar column expressions (time, geography, fare arithmetic)
  operators/  DataFrame -> DataFrame operators (profiles, group statistics, sampling, profiling)
  sources/    scans and sinks (CSV with reject handling, Parquet, report CSV, test-data trips)
  plans/      composed reports, the modelling stages and a multi-report runner
  streaming/  incremental ingest with Structured Streaming
"""

__version__ = "0.1.0"
