"""Null keys and non-finite amounts."""

import math
import random
from fractions import Fraction

from pyspark.sql import functions as F

from farewise.functions import exact_avg, exact_sum
from farewise.operators import group_stats
from farewise.operators.stats import with_group_stat


def test_null_keys_get_their_own_statistic(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 5)], "k string, x int")
    stats = df.groupBy("k").agg(F.sum("x").alias("total"))
    for bound in (None, 3):
        rows = with_group_stat(df, stats, ["k"], bound)
        assert rows.columns == ["k", "x", "total"]
        assert sorted((r.k or "", r.x, r.total) for r in rows.collect()) == [("", 3, 8), ("", 5, 8), ("a", 1, 3),
                                                                            ("a", 2, 3)]


def test_odd_values_come_out_as_a_plain_sum_gives_them(spark):
    nan, inf = math.nan, math.inf
    df = spark.createDataFrame([("n", nan), ("n", 1.0), ("i", inf), ("i", 3.0), ("b", inf), ("b", -inf), ("m", -inf), ("f", 1.25),
                                ("f", 2.25), ("z", None), ("s", 4e-5), ("s", 4e-5), ("s", None), ("h", 1e16), ("h", 1.0), ("h", 1.5),
                                ("t", 1e300), ("t", 1.0), ("0", 0.0), ("0", -0.0)], "k string, x double")
    rows = {r.k: (r.s, r.m) for r in df.groupBy("k").agg(exact_sum("x").alias("s"), exact_avg("x").alias("m")).collect()}
    again = {r.k: (r.s, r.m) for r in group_stats(df, ["k"], sums={"s": "x"}, means={"m": "x"}).collect()}
    for got in (rows, again):
        assert all(math.isnan(v) for v in (*got["n"], *got["b"]))
        assert got["i"] == (inf, inf) and got["m"] == (-inf, -inf) and got["z"] == (None, None)
        assert got["f"] == (3.5, 1.75) and got["s"] == (8e-5, 4e-5) and got["0"] == (0.0, 0.0)
        assert got["h"] == (1e16 + 2, (1e16 + 2) / 3) and got["t"] == (1e300, 5e299)


def test_exact_sums_are_the_rounded_true_sums_in_any_order(spark):
    """Against fractions, with cancellation, over any partitioning and both aggregation levels."""
    rng = random.Random(3)
    values = [rng.choice([1, -1]) * rng.random() * 10.0 ** rng.randint(-6, 18) for _ in range(3000)]
    values += [-v for v in values[:2990]] + [0.1] * 1000 + [2.675, 1e-7, 2.0 ** 71, -(2.0 ** 71)]
    exact = float(sum(Fraction(v) for v in values))
    assert math.fsum(values) == exact
    for n in (1, 3, 7):
        rng.shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(n)
        assert df.agg(exact_sum("x")).first()[0] == exact
        two = group_stats(df, [], sums={"s": "x"}, quantiles={"q": ("x", 0.5)}, method="kll").first()
        assert two.s == df.agg(exact_sum("x")).first()[0]


def test_sums_have_room_for_many_rows(spark):
    """Limb sums of 2^38 rows of the greatest values still fit: the first limb is below 2^24, the others at most 2^23."""
    from farewise.functions.exact_sum import LIMIT, limbs

    big = math.nextafter(LIMIT, 0)
    df = spark.createDataFrame([(big,), (-big,), (1 / 3,), (-0.1,)], "x double")
    for row in df.select(*limbs(F.col("x"))).collect():
        assert all(abs(v) <= 1 << 24 for v in row[:-1]) and row[-1] is None
