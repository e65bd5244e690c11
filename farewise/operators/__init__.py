"""DataFrame -> DataFrame operators: filters and profiles, group statistics, profiling, sampling."""

from farewise.operators.profiles import (
    PROFILES, clean, drop_incomplete, profile_predicate, rate_guard, require_not_null, with_fare_per_mile, within_bbox,
)
from farewise.operators.quality import preview, profile_shape, rule_counts, violation_counts
from farewise.operators.sampling import bernoulli_sample, hash_sample, hash_unit, holdout_split
from farewise.operators.quantiles import SET_COL, exact_percentiles, group_stats, group_stats_sets
from farewise.operators.stats import broadcast_if_bounded, keep_top_n, percentiles, top_k, top_keys, with_group_stat

__all__ = [
    "PROFILES", "clean", "drop_incomplete", "profile_predicate", "rate_guard", "require_not_null", "with_fare_per_mile",
    "within_bbox", "preview", "profile_shape", "rule_counts", "violation_counts", "bernoulli_sample",
    "hash_sample", "hash_unit", "holdout_split", "broadcast_if_bounded", "keep_top_n", "percentiles", "top_k", "top_keys",
    "exact_percentiles", "group_stats", "group_stats_sets", "SET_COL",
    "with_group_stat",
]
