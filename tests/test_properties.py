"""Property tests: operators against plain-Python statements of their semantics."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from farewise.config import PAYMENT_LABELS, REGIME_EDGES, REGIME_LABELS
from farewise.functions import bucketize, decode, sum_components

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
finite = st.floats(min_value=-1e6, max_value=1e6, allow_nan=False, allow_infinity=False)


def _regime(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return REGIME_LABELS[-1]
    for edge, label in zip(REGIME_EDGES, REGIME_LABELS):
        if x <= edge:
            return label
    return REGIME_LABELS[-1]


def _disc(values, p):
    vals = sorted(v for v in values if v is not None)
    if not vals:
        return None
    return vals[max(1, math.ceil(p * len(vals))) - 1]


@SETTINGS
@given(st.lists(st.one_of(st.none(), finite, st.sampled_from([1.0, 5.0, 0.0])), min_size=1, max_size=40))
def test_bucketize_matches_python(spark, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = [r.r for r in df.select("i", bucketize("x", REGIME_EDGES, REGIME_LABELS).alias("r")).orderBy("i").collect()]
    assert got == [_regime(x) for x in xs]


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.integers(min_value=-3, max_value=9)), min_size=1, max_size=30),
       st.lists(st.tuples(st.one_of(st.none(), finite), st.one_of(st.none(), finite)), min_size=1, max_size=30))
def test_decode_and_components_match_python(spark, codes, pairs):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, c int")
    got = [r.l for r in df.select("i", decode("c", PAYMENT_LABELS, "Other").alias("l")).orderBy("i").collect()]
    assert got == [PAYMENT_LABELS.get(c, "Other") for c in codes]
    df2 = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a double, b double")
    sums = [r.s for r in df2.select("i", sum_components(["a", "b"]).alias("s")).orderBy("i").collect()]
    assert sums == [(a or 0.0) + (b or 0.0) for a, b in pairs]


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.one_of(st.none(), st.integers(0, 50).map(float))),
                min_size=1, max_size=120),
       st.sampled_from(["bracket", "kll", "exact", "sketch"]))
def test_percentile_methods_match_discrete_definition(spark, rows, method):
    from farewise.operators import group_stats

    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    levels = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    got = {r.g: r for r in group_stats(df, ["g"], count_as="n", quantiles={k: ("v", p) for k, p in levels.items()},
                                       method=method, salts=2,
                                       kll_k=8 if method == "bracket" else None).collect()}
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g].n == len(vs)
        for name, p in levels.items():
            assert got[g][name] == _disc(vs, p), (method, g, name)


def test_top_k_never_drops_rows_before_the_cut(spark):
    from farewise.operators import top_k

    df = spark.range(0, 200).select((F.col("id") % 7).alias("k"), (F.col("id") % 5).alias("n"))
    agg = df.groupBy("k").agg(F.sum("n").alias("s"))
    full = sorted(agg.collect(), key=lambda r: (-r.s, r.k))
    assert [tuple(r) for r in top_k(agg, [F.desc("s")], 4, ["k"]).collect()] == [tuple(r) for r in full[:4]]
