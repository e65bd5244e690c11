"""Scalar column functions: time, geography, fare arithmetic (all built-in, codegen-friendly)."""

from farewise.functions.exact_sum import exact_avg, exact_sum
from farewise.functions.fare import bucketize, decode, share, sum_components, unit_rate
from farewise.functions.geo import grid_bin, grid_id, within_bbox
from farewise.functions.time import (
    day_name, duration_minutes, duration_seconds, is_weekend, pickup_date, pickup_hour,
)

__all__ = [
    "bucketize", "decode", "exact_avg", "exact_sum", "share", "sum_components", "unit_rate", "grid_bin", "grid_id", "within_bbox", "day_name", "duration_minutes", "duration_seconds",
    "is_weekend", "pickup_date", "pickup_hour",
]
