"""Sums of doubles that do not depend on the order of addition.

A value is split into ``LIMBS`` signed integers of about 24 bits, multiples of 2^48, 2^24, 1, 2^-24, 2^-48 and 2^-72, whose sums are
kept in longs: integer addition is exact in any order, in any number of levels, for up to 2^39 rows. Every double from 2^-20 to 2^72 in magnitude is
held exactly, and smaller ones to the nearest multiple of 2^-72. The limb sums become one double at the end, rounded to the nearest.

What is not below 2^72 (NaN, the infinities, 4.7e21 and more) is summed as a plain double beside the limbs: NaN and infinities give what a
plain sum gives; finite values of that size are the only ones whose last digits may still depend on the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMB_BITS = 24
LIMBS = 6
#: Exponent of the unit of the first limb.
TOP = 48
LIMIT = float(2 ** (TOP + LIMB_BITS))


def limbs(col: Column) -> list[Column]:
    """The limbs of a double (longs, highest first) and the value itself where it has none; sum each of them."""
    x = F.when(F.abs(col) < F.lit(LIMIT), col)
    unit = [2.0 ** (i * LIMB_BITS - TOP) for i in range(LIMBS)]
    whole = [F.rint(x * F.lit(u)) for u in unit]
    out = [whole[0].cast("long")]
    out += [(whole[i] - whole[i - 1] * F.lit(float(1 << LIMB_BITS))).cast("long") for i in range(1, LIMBS)]
    return [*out, F.when(F.abs(col) >= F.lit(LIMIT), col)]


def total(sums: Sequence[Column]) -> Column:
    """The sum from the sums of ``limbs``; null if there was no value."""
    *parts, odd = sums
    low = [None] * LIMBS
    carry = F.lit(0).cast("long")
    for i in range(LIMBS - 1, 0, -1):
        s = parts[i] + carry
        low[i], carry = s.bitwiseAND(F.lit((1 << LIMB_BITS) - 1)).cast("double"), F.shiftright(s, LIMB_BITS)
    top = (parts[0] + carry).cast("double")
    one = F.lit(float(1 << LIMB_BITS))
    middle = low[1] * one + low[2]
    rest = (low[3] * one + low[4]) * F.lit(2.0 ** -TOP) + low[5] * F.lit(2.0 ** -(TOP + LIMB_BITS))
    # the whole part is exact below 2^53; above, all that counts of the rest is whether there is any
    value = F.when(F.abs(top) < F.lit(2.0 ** (53 - TOP)), (top * F.lit(2.0 ** TOP) + middle) + rest) \
        .otherwise(top * F.lit(2.0 ** TOP) + (middle + F.when(rest > 0, F.lit(0.5)).otherwise(F.lit(0.0))))
    return F.when(odd.isNull(), value).otherwise(F.coalesce(value, F.lit(0.0)) + odd)


def exact_sum(col: str | Column) -> Column:
    """Aggregate: the sum of a column as a double."""
    c = F.col(col) if isinstance(col, str) else col
    return total([F.sum(x) for x in limbs(c.cast("double"))])


def exact_avg(col: str | Column) -> Column:
    """Aggregate: the mean of a column as a double."""
    c = F.col(col) if isinstance(col, str) else col
    return F.try_divide(exact_sum(c), F.count(c))
