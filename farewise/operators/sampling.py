"""Deterministic hash sampling and train / test split by row key.

The unit value is derived from md5 of ``<salt>:<seed>:<key>``; the same
expression is available in plain SQL engines, so samples and splits are
repeatable anywhere and independent of partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewise.config import SEED, TEST_FRACTION

_HASH_HEX_DIGITS = 8
_HASH_RANGE = float(16 ** _HASH_HEX_DIGITS)

SPLIT_COL = "is_test"


def hash_unit(key: str | Column, seed: int = SEED, salt: str = "split") -> Column:
    """A value in [0, 1) from the first 32 bits of md5(salt:seed:key)."""
    k = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat_ws(":", F.lit(salt), F.lit(str(seed)), k.cast("string")))
    bits = F.conv(F.substring(digest, 1, _HASH_HEX_DIGITS), 16, 10).cast("bigint")
    return bits / F.lit(_HASH_RANGE)


def row_key(df: DataFrame, key: str | None) -> Column:
    """The given key column, or a 64-bit hash of all columns for tables without one."""
    if key:
        return F.col(key)
    return F.xxhash64(*[F.col(c) for c in df.columns])


def hash_sample(df: DataFrame, fraction: float, key: str | None = None, seed: int = SEED) -> DataFrame:
    """Keep a row when its hash unit is below ``fraction`` (a deterministic Bernoulli sample)."""
    if fraction >= 1.0:
        return df
    return df.filter(hash_unit(row_key(df, key), seed, "sample") < F.lit(fraction))


def bernoulli_sample(df: DataFrame, fraction: float, seed: int = SEED) -> DataFrame:
    """Spark's own Bernoulli sample without replacement (depends on partitioning)."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def holdout_split(df: DataFrame, key: str | None = None, test_fraction: float = TEST_FRACTION,
                  seed: int = SEED) -> DataFrame:
    """Add boolean ``is_test``: one split shared by every model trained on the frame."""
    return df.withColumn(SPLIT_COL, hash_unit(row_key(df, key), seed, "split") < F.lit(test_fraction))
