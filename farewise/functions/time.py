"""Calendar and duration features of a timestamp column (TIMESTAMP or TIMESTAMP_NTZ)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from farewise.config import WEEKEND_DAYS

# dayofweek numbers of the weekend day names (1 = Sun ... 7 = Sat)
_DAY_NUMBERS = {"Sun": 1, "Mon": 2, "Tue": 3, "Wed": 4, "Thu": 5, "Fri": 6, "Sat": 7}
_WEEKEND_NUMBERS = tuple(_DAY_NUMBERS[d] for d in WEEKEND_DAYS)


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def duration_seconds(start: str | Column, end: str | Column) -> Column:
    """Whole-second difference end - start (bigint).

    ``unix_timestamp`` works for both timestamp types; ``cast(ts as long)``
    does not accept TIMESTAMP_NTZ, so both spellings of the duration map here.
    """
    return F.unix_timestamp(_c(end)) - F.unix_timestamp(_c(start))


def duration_minutes(start: str | Column, end: str | Column) -> Column:
    return duration_seconds(start, end) / F.lit(60.0)


def pickup_hour(ts: str | Column) -> Column:
    return F.hour(_c(ts))


def pickup_date(ts: str | Column) -> Column:
    return F.to_date(_c(ts))


def day_name(ts: str | Column) -> Column:
    """Three-letter English day name (Mon, Tue, ...)."""
    return F.date_format(_c(ts), "E")


def is_weekend(ts: str | Column) -> Column:
    """True on Saturday and Sunday (day names in WEEKEND_DAYS); null for a null timestamp.

    Evaluated as ``dayofweek`` (1 = Sunday, 7 = Saturday) rather than by
    formatting a day name per row.
    """
    return F.dayofweek(_c(ts)).isin(*_WEEKEND_NUMBERS)
