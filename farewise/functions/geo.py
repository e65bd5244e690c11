"""Location features: grid cells and the bounding-box predicate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def grid_bin(coord: str | Column, digits: int) -> Column:
    """Coordinate rounded (HALF_UP) to ``digits`` decimals."""
    return F.round(_c(coord), digits)


def grid_id(lat_bin: str | Column, lon_bin: str | Column) -> Column:
    """String cell key such as ``40.7_-73.98``; null parts are skipped."""
    return F.concat_ws("_", _c(lat_bin).cast("string"), _c(lon_bin).cast("string"))


def within_bbox(lat: str | Column, lon: str | Column, lat_range: tuple[float, float],
                lon_range: tuple[float, float]) -> Column:
    """Inclusive bounding box; null coordinates are outside."""
    return _c(lat).between(*lat_range) & _c(lon).between(*lon_range)
