"""Every registered query with an oracle equals its DuckDB statement (sf0.001)."""

import pytest

import __spark_entry__ as entry
from helpers import rows_of_duck, rows_of_spark

from conftest import SF_SMALL
from farewise.plans.catalog import QUERIES

ORACLE = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}


def test_every_query_is_callable_and_most_have_oracles():
    assert set(ORACLE) <= set(QUERIES)
    rows_only = set(QUERIES) - set(ORACLE)
    assert rows_only == {"bernoulli_sample", "model_metrics", "residual_report_both", "residual_table_both",
                         "residuals_overall_both", "residuals_by_weekend_both", "residuals_by_regime_both"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    s_cols, s_rows = rows_of_spark(QUERIES[name](spark, SF_SMALL))
    d_cols, d_rows = rows_of_duck(duck, ORACLE[name])
    assert s_cols == d_cols
    assert len(s_rows) == len(d_rows)
    assert s_rows == d_rows


def test_entry_runs_with_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["distance_regime", "is_weekend", "pickup_hour", "trips", "median_abs_dev",
                          "p90_abs_dev", "avg_dev"]
    assert df.count() > 0


@pytest.mark.parametrize("name,method", [
    ("hourly_demand_revenue", "kll"), ("payment_split", "kll"), ("regime_deviation_summary", "kll"),
    ("deviation_by_time", "kll"), ("decomposition_by_time", "kll"), ("deviation_by_time", "exact"),
    ("decomposition_by_time", "sketch"), ("hourly_demand_revenue", "digits"), ("deviation_by_time", "digits"),
    ("regime_deviation_summary", "digits"),
])
def test_reports_do_not_depend_on_partitioning(spark, name, method):
    """Trips spread over 13 partitions (many map tasks, several salts) give the oracle's answer."""
    from dataclasses import replace

    import duckdb

    from farewise.config import DEFAULT
    from farewise.plans import reports
    from farewise.sources import trips_table

    from conftest import SF_MED

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF_MED}/events.parquet')")
    trips = trips_table(spark, SF_MED).repartition(13)
    df = getattr(reports, name)(trips, replace(DEFAULT, percentile_method=method))
    assert rows_of_spark(df) == rows_of_duck(con, ORACLE[name])
