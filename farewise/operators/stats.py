"""Group statistics: percentiles, self-aggregate joins, deterministic top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewise.session import materialize

# Largest proven row bound for which a statistics side is broadcast.
BROADCAST_ROW_LIMIT = 100_000
# Hash buckets of the first scan of ``top_keys``.
TOP_KEY_BUCKETS = 65_536


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def percentiles(df: DataFrame, keys: Sequence[str], col: str, levels: dict[str, float],
                accuracy: int | None = None, count_as: str | None = None, method: str | None = None,
                kll_k: int | None = None) -> DataFrame:
    """One row per group: optional row count and the named percentiles of ``col``.

    See ``operators.quantiles`` for the methods.
    """
    from farewise.operators.quantiles import group_stats

    return group_stats(df, keys, count_as=count_as, quantiles={name: (col, p) for name, p in levels.items()},
                       method=method, accuracy=accuracy, kll_k=kll_k)


def broadcast_if_bounded(stats: DataFrame, max_rows: int | None,
                         limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast hint only behind a proven row bound; otherwise leave the choice to AQE."""
    if max_rows is not None and max_rows <= limit:
        return F.broadcast(stats)
    return stats


def with_group_stat(df: DataFrame, stats: DataFrame, keys: Sequence[str], max_groups: int | None = None) -> DataFrame:
    """Left-join every row to the statistics of its own group.

    ``max_groups`` is a bound known from the key domain (e.g. the number of
    regime labels); with it the statistics side is broadcast and the big side
    is never shuffled. Without it the join is planned from runtime sizes.
    Null keys form a group of their own, as in the grouping that made ``stats``.
    """
    side = stats.withColumnsRenamed({k: f"_group_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & df[k].eqNullSafe(side[f"_group_{k}"])
    joined = df.join(broadcast_if_bounded(side, max_groups), on=same, how="left")
    others = [c for c in df.columns if c not in keys]
    return joined.select(*[df[k] for k in keys], *[df[c] for c in others],
                         *[side[c] for c in stats.columns if c not in keys])


def top_k(df: DataFrame, order: Sequence[Column], k: int, tie_keys: Sequence[str] = ()) -> DataFrame:
    """The first k rows under ``order``, ties broken by ``tie_keys`` ascending (nulls first).

    Planned as TakeOrderedAndProject: each task keeps only k rows.
    """
    tie = [F.col(t).asc_nulls_first() for t in tie_keys]
    return df.orderBy(*order, *tie).limit(k)


def top_keys(df: DataFrame, key: str, n: int, method: str = "count", buckets: int = TOP_KEY_BUCKETS) -> DataFrame:
    """The n most frequent non-null keys (``key``, ``_n``), ties broken by key.

    method="count": one aggregate over all keys; its shuffle grows with the
    number of distinct keys.
    method="buckets": for keys of high cardinality. The first scan counts rows
    per hash bucket, which bounds every key of the bucket from above; the
    second counts only the keys of the fullest buckets. If the n-th of them
    beats the fullest bucket left out, no other key can be among the n;
    otherwise all keys are counted. Both shuffles are bounded by ``buckets``
    and by the keys of ``8 * n`` buckets. Jobs run while the DataFrame is built.
    """
    if method not in ("count", "buckets"):
        raise ValueError("method must be 'count' or 'buckets'")
    keys = df.select(key).filter(F.col(key).isNotNull())

    def counted(rows: DataFrame) -> DataFrame:
        return top_k(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), [F.col("_n").desc()], n, [key])

    if method == "count" or n < 1:
        return counted(keys)
    bucketed = keys.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    totals = materialize(bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows")), "key-buckets")
    full = min(8 * n, buckets)
    fullest = totals.orderBy(F.col("_rows").desc(), "_bucket").limit(full + 1).collect()  # at most 8 n + 1 rows
    left_out = fullest[full]["_rows"] if len(fullest) > full else 0
    chosen = df.sparkSession.createDataFrame([(r["_bucket"],) for r in fullest[:full]], "_bucket long")
    top = materialize(counted(bucketed.join(broadcast_if_bounded(chosen, full), "_bucket", "left_semi")), "top-keys")
    held = top.agg(F.count(F.lit(1)).alias("found"), F.min("_n").alias("least")).first()
    decided = left_out == 0 or (held["found"] == n and held["least"] > left_out)
    return top if decided else counted(keys)


def keep_top_n(df: DataFrame, key: str, n: int, out: str, other: str = "other", method: str = "count") -> DataFrame:
    """``out`` = ``key`` when it is among the n most frequent keys, else ``other``.

    The n keys (``top_keys``) are joined back as a broadcast of at most n rows.
    Ties in frequency are broken by key so the cut is deterministic; a null key
    never matches and becomes ``other``.
    """
    top = top_keys(df, key, n, method).select(F.col(key).alias("_top_key"))
    joined = df.join(broadcast_if_bounded(top, n), F.col(key) == F.col("_top_key"), "left")
    return joined.withColumn(out, F.coalesce(F.col("_top_key"), F.lit(other))).drop("_top_key")
