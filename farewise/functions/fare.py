"""Fare arithmetic: ratios, component sums, code decoding, regimes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def unit_rate(num: str | Column, den: str | Column) -> Column:
    """num / den, null when den is 0 (safe under ANSI mode)."""
    return F.try_divide(_c(num), _c(den))


def share(part: str | Column, whole: str | Column) -> Column:
    return F.try_divide(_c(part), _c(whole))


def sum_components(cols: Sequence[str | Column]) -> Column:
    """Sum of the columns with nulls counted as 0, added left to right."""
    parts = [F.coalesce(_c(c), F.lit(0.0)) for c in cols]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def decode(col: str | Column, mapping: Mapping[object, str], default: str) -> Column:
    """CASE chain from a code -> label mapping; null and unknown codes get ``default``."""
    c = _c(col)
    expr = None
    for code, label in mapping.items():
        expr = F.when(c == F.lit(code), F.lit(label)) if expr is None else expr.when(c == F.lit(code), F.lit(label))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def bucketize(col: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed buckets: x <= e0 -> l0, e0 < x <= e1 -> l1, ... else the last label.

    Null and NaN fall into the last label (NaN compares above every number).
    ``ml.feature.Bucketizer`` is left-closed, so a CASE chain is used instead.
    """
    if len(labels) != len(edges) + 1:
        raise ValueError("need exactly one more label than edges")
    c = _c(col)
    expr = F.when(c <= F.lit(edges[0]), F.lit(labels[0]))
    for edge, label in zip(edges[1:], labels[1:-1]):
        expr = expr.when(c <= F.lit(edge), F.lit(label))
    return expr.otherwise(F.lit(labels[-1]))
