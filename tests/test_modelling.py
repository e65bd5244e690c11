"""Modelling: linear fit vs pyspark.ml, encoder on unseen categories, forest behaviour."""

import pytest
from pyspark.sql import functions as F

from farewise.plans import modelling as ml
from farewise.plans.catalog import TOP_N_TEST
from farewise.sources import TRIP_KEY, load_trips

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def dataset(spark):
    return ml.ml_fare_dataset(load_trips(spark, SF_SMALL), top_n=TOP_N_TEST, key=TRIP_KEY).cache()


def test_dataset_shape(dataset):
    assert dataset.columns[1:] == ["label_fare_amount", "trip_distance", "pickup_hour", "is_weekend", "RateCodeID",
                                   "pickup_grid_top", "fixed_fees", "tolls", "trip_duration_mins", "fare_per_mile",
                                   "distance_regime"]
    assert dataset.count() == 866
    assert dataset.select("pickup_grid_top").distinct().count() == TOP_N_TEST + 1


def test_split_is_deterministic_and_disjoint(dataset):
    a = ml.split_dataset(dataset, TRIP_KEY).select(TRIP_KEY, "is_test")
    b = ml.split_dataset(dataset, TRIP_KEY).select(TRIP_KEY, "is_test")
    assert sorted(a.collect()) == sorted(b.collect())
    share = a.agg(F.avg(F.col("is_test").cast("double"))).first()[0]
    assert 0.1 < share < 0.3


def test_linear_fit_equals_pyspark_ml(dataset):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    model = ml.fit_linear(dataset)
    vec = VectorAssembler(inputCols=["trip_distance"], outputCol="f").transform(dataset)
    ref = LinearRegression(featuresCol="f", labelCol=ml.LABEL, regParam=0.0, solver="normal").fit(vec)
    assert model.slope == pytest.approx(ref.coefficients[0], rel=1e-9)
    assert model.intercept == pytest.approx(ref.intercept, rel=1e-9)


def test_unseen_category_encodes_as_zeros(spark):
    train = spark.createDataFrame([(1.0, 1, False, 1, "a"), (2.0, 2, True, 2, "b")],
                                  "trip_distance double, pickup_hour int, is_weekend boolean, RateCodeID int, "
                                  "pickup_grid_top string")
    train = train.withColumns({"fixed_fees": F.lit(0.0), "tolls": F.lit(0.0), "trip_duration_mins": F.lit(1.0)})
    test = train.withColumn("pickup_grid_top", F.lit("zzz")).withColumn("RateCodeID", F.lit(9))
    enc = ml.encode_features(train, test).select("features").collect()
    for r in enc:
        one_hot = r.features[5:]
        # is_weekend known (two slots, one set); RateCodeID and grid unseen -> zeros
        assert sum(one_hot[:2]) == 1.0
        assert sum(one_hot[2:]) == 0.0


def test_forest_same_seed_same_result_and_beats_linear_on_nonlinear_fare(spark):
    rows = []
    for i in range(400):
        d = (i % 40) / 4.0 + 0.1
        hour = i % 24
        fare = 2.5 + 2.0 * d + (15.0 if hour in (7, 8, 17, 18) else 0.0)
        rows.append((i, fare, d, hour, i % 7 >= 5, 1 + i % 3, f"g{i % 4}", 1.3, 0.0, d * 3.0))
    df = spark.createDataFrame(rows, "trip_id long, label_fare_amount double, trip_distance double, pickup_hour int, "
                                     "is_weekend boolean, RateCodeID int, pickup_grid_top string, fixed_fees double, "
                                     "tolls double, trip_duration_mins double")
    params = {"num_trees": 10, "max_bins": 32}
    _, t1 = ml.train_and_evaluate(df, "trip_id", forest_params=params)
    _, t2 = ml.train_and_evaluate(df, "trip_id", forest_params=params)
    m1 = {r.model: r for r in ml.model_metrics(t1, {v: k for k, v in ml.METRIC_NAMES.items()}, 1.0).collect()}
    m2 = {r.model: r for r in ml.model_metrics(t2, {v: k for k, v in ml.METRIC_NAMES.items()}, 1.0).collect()}
    assert m1 == m2
    lin, rf = m1[ml.METRIC_NAMES[ml.PRED0]], m1[ml.METRIC_NAMES[ml.PRED1]]
    assert rf.MAE < lin.MAE and rf.RMSE < lin.RMSE


def test_registered_forest_has_the_published_size():
    from farewise.plans import catalog

    assert catalog.FOREST_TEST["num_trees"] == 200 and catalog.FOREST_TEST["min_instances"] == 5


def test_a_tree_takes_the_best_split_of_every_node():
    """Against a plain search over all splits of one-hot and numeric columns on the same bootstrap."""
    import numpy as np
    import pandas as pd

    from farewise.plans import forest as f

    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"x": rng.integers(0, 12, 150).astype(float), "z": rng.random(150).round(2), "c": rng.choice(list("abcd"), 150)})
    y = rows["x"] * 2 + (rows["c"] == "b") * 7 + rng.random(150)
    coding = f.make_coding(rows, ["x", "z"], ["c"], 256)
    tree = f.grow_tree(coding.codes(rows), coding, y.to_numpy(), 5, np.random.default_rng([1, 2]))
    drawn = np.bincount(np.random.default_rng([1, 2]).integers(0, 150, 150), minlength=150)

    def walk(node, live):
        w, t = drawn[live], y.to_numpy()[live]
        n = tree.iloc[node]
        assert n["value"] == pytest.approx((w * t).sum() / w.sum())
        best = (w * t).sum() ** 2 / w.sum()
        options = [rows[c].to_numpy()[live] <= v for c in ("x", "z") for v in rows[c].unique()]
        options += [rows["c"].to_numpy()[live] == v for v in "abcd"]
        gains = [(w[o] * t[o]).sum() ** 2 / w[o].sum() + (w[~o] * t[~o]).sum() ** 2 / w[~o].sum()
                 for o in options if o.sum() >= 5 and (~o).sum() >= 5]
        if n["col"] < 0:
            assert all(g <= best * (1 + 2e-9) + 1e-9 for g in gains)
            return
        col = ["x", "z", "c"][int(n["col"])]
        value = rows[col].to_numpy()[live]
        left = value == coding.labels["c"][int(n["bin"])] if col == "c" else value <= coding.numeric[col][int(n["bin"])]
        got = (w[left] * t[left]).sum() ** 2 / w[left].sum() + (w[~left] * t[~left]).sum() ** 2 / w[~left].sum()
        assert got == pytest.approx(max(gains))
        walk(int(n["left"]), live[left])
        walk(int(n["left"]) + 1, live[~left])

    walk(0, np.flatnonzero(drawn))
    assert len(tree) > 10


def test_forest_does_not_depend_on_partitions_and_predicts_by_its_table(spark, dataset):
    from farewise.plans.forest import fit_forest, predict

    args = (ml.LABEL, ml.NUM_FEATURES, ml.CAT_FEATURES, TRIP_KEY)
    a = fit_forest(dataset.repartition(7), *args, num_trees=7)
    b = fit_forest(dataset.coalesce(1), *args, num_trees=7)
    nodes = a.orderBy("tree", "node").collect()
    assert nodes == b.orderBy("tree", "node").collect()
    by = {(r.tree, r.node): r for r in nodes}

    def value(row, tree):
        n = by[tree, 0]
        while n.feature is not None:
            v = row[n.feature]
            go = str(v).lower() == n.category.lower() if n.category is not None else float(v) <= n.threshold
            n = by[tree, n.left if go else n.right]
        return n.value

    test = dataset.limit(60).withColumn("RateCodeID", F.when(F.col(TRIP_KEY) % 9 == 0, 77).otherwise(F.col("RateCodeID")))
    for r in predict(a, test, ml.NUM_FEATURES, ml.CAT_FEATURES, "p").collect():
        assert r.p == pytest.approx(sum(value(r, t) for t in range(7)) / 7)
    few = fit_forest(dataset, *args, num_trees=2, max_train_rows=100)
    assert few.count() < a.count() and fit_forest(dataset.limit(0), *args).count() == 0


def test_the_node_table_does_not_reach_the_driver(spark, dataset, monkeypatch):
    """Prediction collects 14 bytes a node, packed in tasks, and a forest without nodes predicts nothing."""
    from farewise.plans import forest as f

    args = (ml.NUM_FEATURES, ml.CAT_FEATURES)
    nodes = f.fit_forest(dataset, ml.LABEL, *args, TRIP_KEY, num_trees=6)
    monkeypatch.setattr(type(nodes), "toPandas", None)
    packed, _ = f.pack_trees(nodes, *args)
    size = {r.tree: len(r.packed) for r in packed.collect()}
    assert size == {r.tree: 14 * r["count"] for r in nodes.groupBy("tree").count().collect()} and len(size) == 6
    means = f.predict(nodes, dataset, *args, "p").agg(F.avg("p").alias("p"), F.avg(ml.LABEL).alias("y")).first()
    assert means.p == pytest.approx(means.y, rel=0.05)
    none = f.predict(nodes.limit(0), dataset.limit(3), *args, "p").collect()
    assert [r.p for r in none] == [None] * 3


def test_trees_reach_the_driver_deflated(spark, dataset):
    """A tree comes back as it was, and takes less than 10 of its 14 bytes a node."""
    from farewise.plans import forest as f

    args = (ml.NUM_FEATURES, ml.CAT_FEATURES)
    nodes = f.fit_forest(dataset, ml.LABEL, *args, TRIP_KEY, num_trees=2)
    for r in f.pack_trees(nodes, *args)[0].collect():
        tree = bytes(r.packed)
        assert f.inflated(f.deflated(tree)).tobytes() == tree and len(f.deflated(tree)) < 10 / 14 * len(tree)


def test_residual_cube_equals_the_single_reports(dataset):
    _, test = ml.train_and_evaluate(dataset, TRIP_KEY, with_forest=False)
    res = ml.residual_table(test, {ml.ERR0: ml.PRED0}, key=TRIP_KEY)
    cube = ml.residual_reports(res, {ml.ERR0: "linear"})
    assert cube["overall"].collect() == ml.residuals_overall(res, {ml.ERR0: "linear"}).collect()
    for name, single in (("by_hour", ml.residuals_by(res, "pickup_hour", [ml.ERR0])),
                         ("by_weekend", ml.residuals_by(res, "is_weekend", [ml.ERR0])),
                         ("by_regime", ml.residuals_by_regime(res, [ml.ERR0]))):
        assert cube[name].collect() == single.collect()


def test_linear_plans_neither_shuffle_nor_sort(dataset):
    import contextlib
    import io

    _, test = ml.train_and_evaluate(dataset, TRIP_KEY, with_forest=False)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        test.explain("formatted")
    assert "Exchange" not in buf.getvalue() and "Sort" not in buf.getvalue()


def _many_rows(spark, n):
    """Rows in key order, more than one block of them; the labels depend on the last rows too."""
    key = F.col("id")
    cols = {"trip_distance": (key * 7919 % 1500) / 100.0, "pickup_hour": key % 24, "fixed_fees": key % 3 / 2.0, "tolls": F.lit(0.0),
            "trip_duration_mins": (key * 37 % 11400) / 60.0, "is_weekend": key % 7 >= 5, "RateCodeID": key % 5, "pickup_grid_top": key % 4}
    return spark.range(n).select("id", *[v.alias(k) for k, v in cols.items()]).withColumn(
        ml.LABEL, F.col("trip_distance") * 2 + F.col("pickup_hour") % 5 + F.col("id") / 1000.0).repartition(5)


def test_forest_learns_from_every_row(spark):
    """The mean at a tree's root is that of draws of all 70,000 rows; no bound on the rows is registered or the default."""
    import inspect

    import numpy as np

    from farewise.plans import catalog
    from farewise.plans import forest as f

    assert "max_train_rows" not in catalog.FOREST_TEST and inspect.signature(f.fit_forest).parameters["max_train_rows"].default is None
    n = 70_000
    rows = _many_rows(spark, n)
    nodes = f.fit_forest(rows, ml.LABEL, ml.NUM_FEATURES, ml.CAT_FEATURES, "id", num_trees=2, min_instances=2000)
    y = np.array([r[0] for r in rows.orderBy("id").select(ml.LABEL).collect()])
    for r in nodes.filter("node = 0").collect():
        drawn = np.concatenate([f.draws(42, r.tree, block, n) for block in range(2)])
        assert drawn.sum() == n and r.value == pytest.approx((drawn * y).sum() / n, rel=1e-12)
    assert nodes.filter("node = 0").count() == 2


def test_trees_grown_in_parts_are_the_trees_grown_whole(spark, dataset, monkeypatch):
    """Splits from added histograms above, parts of 60 rows below: same leaves, and the same residuals of every row."""
    from farewise.plans import forest as f

    args = (ml.NUM_FEATURES, ml.CAT_FEATURES)
    whole = f.fit_forest(dataset, ml.LABEL, *args, TRIP_KEY, num_trees=2)
    monkeypatch.setattr(f, "PART_ROWS", 60)
    parts = f.fit_forest(dataset, ml.LABEL, *args, TRIP_KEY, num_trees=2)
    assert parts.filter("part is null").count() > 4 and whole.filter("part is null").count() == 0
    ends = [sorted(r.value for r in n.filter("feature is null").collect()) for n in (whole, parts)]
    assert ends[0] == ends[1] and parts.count() == whole.count()
    a, b = (ml.residual_table(f.predict(n, dataset, *args, ml.PRED1), {ml.ERR1: ml.PRED1}, key=TRIP_KEY) for n in (whole, parts))
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() == dataset.count()


def test_bins_are_quantiles_of_all_rows(spark):
    """Edges and labels found by counts over a table are those of all its rows in memory."""
    import numpy as np

    from farewise.plans import forest as f

    rows = _many_rows(spark, 60_000).select("trip_distance", "trip_duration_mins", "pickup_hour", F.col("RateCodeID").cast("string").alias("c"))
    rows = rows.withColumn("pickup_hour", F.col("pickup_hour").cast("double"))
    nums = ("trip_distance", "trip_duration_mins", "pickup_hour")
    found, want = f.find_coding(rows, nums, ("c",), 64), f.make_coding(rows.toPandas(), nums, ("c",), 64)
    assert found.labels == want.labels and all(np.array_equal(found.numeric[c], want.numeric[c]) for c in nums)
    assert [found.size(c) for c in nums] == [64, 64, 24]


def test_a_bootstrap_draws_from_all_blocks():
    """As many draws as rows, the plain bootstrap of one block, and shares of blocks that differ by tree."""
    import numpy as np

    from farewise.plans import forest as f

    assert np.array_equal(f.draws(42, 3, 0, 50_000), np.bincount(np.random.default_rng([42, 3]).integers(0, 50_000, 50_000), minlength=50_000))
    n = 5 * 65_536 + 100
    some = [[f.draws(42, tree, block, n) for block in range(6)] for tree in range(3)]
    assert all(sum(d.sum() for d in tree) == n and [len(d) for d in tree] == [65_536] * 5 + [100] for tree in some)
    assert all(abs(d.sum() - len(d)) < 6 * len(d) ** 0.5 for tree in some for d in tree)
    assert len({tuple(d.sum() for d in tree) for tree in some}) == 3
    assert abs(np.mean(some[0][0] == 0) - np.exp(-1)) < 0.01


def test_rows_predicted_in_blocks_keep_their_columns(spark):
    """More rows than a block, in several partitions: every row comes back once, with its columns and the mean over its trees."""
    from farewise.plans import forest as f

    rows = _many_rows(spark, 20_000).withColumns({"at": F.timestamp_seconds("id"), "d": F.col("id").cast("decimal(12,2)"), "none": F.lit(None).cast("int")})
    args = (ml.NUM_FEATURES, ml.CAT_FEATURES)
    nodes = f.fit_forest(rows, ml.LABEL, *args, "id", num_trees=2, min_instances=500)
    got = f.predict(nodes, rows, *args, "p")
    assert got.dtypes == [*rows.dtypes, ("p", "double")]
    assert got.drop("p").exceptAll(rows).isEmpty() and got.count() == 20_000
    by = {(r.tree, r.node): r for r in nodes.collect()}

    def value(row, tree):
        n = by[tree, 0]
        while n.feature is not None:
            v = row[n.feature]
            n = by[tree, n.left if (str(v).lower() == n.category.lower() if n.category is not None else float(v) <= n.threshold) else n.right]
        return n.value

    for r in got.filter("id % 97 = 5").collect():
        assert r.p == (value(r, 0) + value(r, 1)) / 2
