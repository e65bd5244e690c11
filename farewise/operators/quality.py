"""Profiling operators: shape, rule violations, deterministic preview."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: the ingest sanity rules (name -> (column, predicate)) ---
DEFAULT_RULES = {
    "negative_trip_distance": ("trip_distance", lambda c: c < 0),
    "negative_total_amount": ("total_amount", lambda c: c < 0),
    "negative_passenger_count": ("passenger_count", lambda c: c < 0),
}
# --- end of fixed values ---


def profile_shape(df: DataFrame) -> DataFrame:
    """One row: row count and column count (a single global aggregate)."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("int").alias("columns"))


def rule_counts(columns: Sequence[str], rules: Mapping[str, tuple[str, object]] | None = None,
                within: Column | None = None) -> list[Column]:
    """Aggregates counting the rows (of ``within``) that break each rule; rules on absent columns are skipped."""
    rules = DEFAULT_RULES if rules is None else rules
    present = set(columns)
    broken = {name: pred(F.col(col)) for name, (col, pred) in rules.items() if col in present}
    return [F.count_if(F.coalesce(b if within is None else within & b, F.lit(False))).alias(name)
            for name, b in broken.items()]


def violation_counts(df: DataFrame, rules: Mapping[str, tuple[str, object]] | None = None,
                     with_rows: bool = True) -> DataFrame:
    """Count rows breaking each rule in one pass; rules on absent columns are skipped."""
    rows = [F.count(F.lit(1)).alias("rows")] if with_rows else []
    return df.agg(*rows, *rule_counts(df.columns, rules))


def preview(df: DataFrame, cols: Sequence[str], n: int, order_by: Sequence[str]) -> DataFrame:
    """First n rows of a projection under a stable order (top-k, not a full sort)."""
    return df.select(*cols).orderBy(*[F.col(c).asc_nulls_first() for c in order_by]).limit(n)
