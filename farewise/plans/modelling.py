"""Modelling on Spark: the modelling table, a deterministic split, a distance-only
linear model, a context-aware random forest (``plans.forest``) and residual reports.

Everything stays distributed: the linear fit is one global aggregate
(``regr_slope`` / ``regr_intercept``, partial aggregation per task) and only
its two coefficients reach the driver; the forest's trees grow in parallel tasks
from every training row; predictions and residuals are column expressions or one
pass over the test split. The published analysis trained on a
1 % pandas sample; here the sample fraction is a parameter (default: all rows).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewise.config import (
    DEFAULT, FOREST_MODEL_NAME, FOREST_REPORT_NAME, LINEAR_MODEL_NAME, LINEAR_REPORT_NAME, SEED, TEST_FRACTION,
    TOP_N_CATEGORIES, FareConfig,
)
from farewise.functions import bucketize
from farewise.operators import SET_COL, drop_incomplete, group_stats_sets, hash_sample, holdout_split, keep_top_n
from farewise.operators.profiles import FARE_PER_MILE, TRIP_DURATION_MINS
from farewise.operators.sampling import SPLIT_COL
from farewise.plans.features import GRID, HOUR, REGIME, WEEKEND, prepare
from farewise.plans.forest import fit_forest, predict
from farewise.session import materialize

LABEL = "label_fare_amount"
GRID_TOP = "pickup_grid_top"
NUM_FEATURES = ("trip_distance", HOUR, "fixed_fees", "tolls", TRIP_DURATION_MINS)
CAT_FEATURES = (WEEKEND, "RateCodeID", GRID_TOP)
PRED0, PRED1 = "y_pred_model0", "y_pred_model1"
ERR0, ERR1 = "abs_err_model0", "abs_err_model1"
METRIC_DIGITS = 6


# ---------------------------------------------------------------- modelling table

def ml_fare_dataset(trips: DataFrame, cfg: FareConfig = DEFAULT, top_n: int = TOP_N_CATEGORIES,
                    key: str | None = None) -> DataFrame:
    """The 11-column modelling table (optionally led by a row key), no nulls.

    Rare pickup cells are mapped to ``other`` through a broadcast join against
    the top-n cells (n rows), never through a collected literal list.
    """
    c = cfg.cols
    df = keep_top_n(prepare(trips, "modelling", cfg), GRID, top_n, GRID_TOP)
    cols = ([F.col(key)] if key else []) + [
        F.col(c.fare).alias(LABEL), F.col(c.distance), F.col(HOUR), F.col(WEEKEND), F.col(c.rate_code),
        F.col(GRID_TOP), F.col("fixed_fees"), F.col("tolls"), F.col(TRIP_DURATION_MINS), F.col(FARE_PER_MILE),
        F.col(REGIME),
    ]
    return drop_incomplete(df.select(*cols))


def split_dataset(ds: DataFrame, key: str | None, sample_fraction: float = 1.0,
                  test_fraction: float = TEST_FRACTION, seed: int = SEED) -> DataFrame:
    """Deterministic sample, then one train / test split (``is_test``) shared by both models."""
    return holdout_split(hash_sample(ds, sample_fraction, key, seed), key, test_fraction, seed)


# ---------------------------------------------------------------- linear model

@dataclass(frozen=True)
class LinearModel:
    slope: float
    intercept: float
    n: int
    x: str = "trip_distance"

    def predict(self, x: str | Column | None = None) -> Column:
        col = F.col(x or self.x) if not isinstance(x, Column) else x
        return F.lit(self.intercept) + F.lit(self.slope) * col


def linear_fit_frame(train: DataFrame, x: str = "trip_distance", y: str = LABEL) -> DataFrame:
    """Least-squares slope and intercept of y on x as one global aggregate (one row)."""
    return train.agg(
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.regr_count(F.col(y), F.col(x)).alias("n_train"),
    )


def fit_linear(train: DataFrame, x: str = "trip_distance", y: str = LABEL) -> LinearModel:
    row = linear_fit_frame(train, x, y).first()
    if row is None or row["slope"] is None:
        raise ValueError("linear fit needs at least two distinct x values")
    return LinearModel(float(row["slope"]), float(row["intercept"]), int(row["n_train"]), x)


# ---------------------------------------------------------------- one-hot encoding

def feature_stages(num_features=NUM_FEATURES, cat_features=CAT_FEATURES, out: str = "features"):
    """Numeric pass-through + one-hot of the categories; unseen categories encode as all zeros.

    StringIndexer(handleInvalid='keep') maps unseen labels to an extra index
    that OneHotEncoder(dropLast=True) drops, giving the zero vector.
    """
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    idx_cols = [f"{c}__idx" for c in cat_features]
    ohe_cols = [f"{c}__ohe" for c in cat_features]
    indexer = StringIndexer(inputCols=[f"{c}__str" for c in cat_features], outputCols=idx_cols,
                            handleInvalid="keep", stringOrderType="frequencyDesc")
    encoder = OneHotEncoder(inputCols=idx_cols, outputCols=ohe_cols, dropLast=True)
    assembler = VectorAssembler(inputCols=list(num_features) + ohe_cols, outputCol=out)
    return [indexer, encoder, assembler]


def with_category_strings(df: DataFrame, cat_features=CAT_FEATURES) -> DataFrame:
    return df.withColumns({f"{c}__str": F.col(c).cast("string") for c in cat_features})


def encode_features(train: DataFrame, apply_to: DataFrame) -> DataFrame:
    """Fit the encoding on ``train`` and apply it to ``apply_to`` (features as an array column)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    model = Pipeline(stages=feature_stages()).fit(with_category_strings(train))
    out = model.transform(with_category_strings(apply_to))
    return out.withColumn("features", vector_to_array("features", "float64"))


# ---------------------------------------------------------------- metrics and residuals

def model_metrics(test: DataFrame, models: dict[str, str], sample_fraction: float, y: str = LABEL) -> DataFrame:
    """One row per model: name, sample fraction, MAE, RMSE (one pass over the test split)."""
    aggs = []
    for name, pred in models.items():
        err = F.col(y) - F.col(pred)
        aggs.append(F.struct(F.lit(name).alias("model"), F.lit(float(sample_fraction)).alias("sample_frac"),
                             F.round(F.avg(F.abs(err)), METRIC_DIGITS).alias("MAE"),
                             F.round(F.sqrt(F.avg(err * err)), METRIC_DIGITS).alias("RMSE")))
    return test.agg(F.array(*aggs).alias("m")).select(F.inline("m"))


def residual_table(test: DataFrame, preds: dict[str, str], key: str | None = None, y: str = LABEL) -> DataFrame:
    """Truth, predictions, context columns and absolute errors (``abs_err_<model suffix>``)."""
    cols = ([F.col(key)] if key else []) + [F.col(y).alias("y_true")]
    cols += [F.col(p) for p in preds.values()]
    cols += [F.col("trip_distance"), F.col(HOUR), F.col(WEEKEND)]
    cols += [F.abs(F.col(y) - F.col(p)).alias(err) for err, p in preds.items()]
    return test.select(*cols)


def residuals_overall(res: DataFrame, names: dict[str, str], digits: int = METRIC_DIGITS) -> DataFrame:
    """One row per model: mean absolute error over the whole residual table."""
    aggs = [F.struct(F.lit(label).alias("model"), F.round(F.avg(err), digits).alias("avg_abs_error"))
            for err, label in names.items()]
    return res.agg(F.array(*aggs).alias("m")).select(F.inline("m"))


def residuals_by(res: DataFrame, key: str | Column, errs: list[str], digits: int = METRIC_DIGITS) -> DataFrame:
    keycol = F.col(key) if isinstance(key, str) else key
    name = key if isinstance(key, str) else REGIME
    return (res.groupBy(keycol.alias(name)).agg(*[F.round(F.avg(e), digits).alias(e) for e in errs])
            .orderBy(name))


def residuals_by_regime(res: DataFrame, errs: list[str], cfg: FareConfig = DEFAULT) -> DataFrame:
    return residuals_by(res, bucketize("trip_distance", cfg.regime_edges, cfg.regime_labels), errs)


def residual_reports(res: DataFrame, names: dict[str, str], cfg: FareConfig = DEFAULT,
                     digits: int = METRIC_DIGITS) -> dict[str, DataFrame]:
    """``overall``, ``by_hour``, ``by_weekend`` and ``by_regime`` of a residual table from one scan (GROUPING SETS)."""
    keys = {"by_hour": HOUR, "by_weekend": WEEKEND, "by_regime": REGIME}
    rows = res.withColumn(REGIME, bucketize("trip_distance", cfg.regime_edges, cfg.regime_labels))
    stats = materialize(group_stats_sets(rows, [[], *[[k] for k in keys.values()]], means={e: e for e in names}), "residual-cube")

    def part(i: int) -> DataFrame:
        return stats.filter(F.col(SET_COL) == F.lit(i))

    overall = F.array(*[F.struct(F.lit(label).alias("model"), F.round(F.col(err), digits).alias("avg_abs_error"))
                        for err, label in names.items()])
    out = {"overall": part(0).select(F.inline(overall))}
    for i, (name, key) in enumerate(keys.items()):
        out[name] = part(i + 1).select(key, *[F.round(F.col(e), digits).alias(e) for e in names]).orderBy(key)
    return out


REPORT_NAMES = {ERR0: LINEAR_REPORT_NAME, ERR1: FOREST_REPORT_NAME}
METRIC_NAMES = {PRED0: LINEAR_MODEL_NAME, PRED1: FOREST_MODEL_NAME}


def train_and_evaluate(ds: DataFrame, key: str | None, sample_fraction: float = 1.0, with_forest: bool = True,
                       forest_params: dict | None = None, seed: int = SEED):
    """Split, fit both models on the train part, predict the test part.

    Returns (linear model, test frame with predictions). The split frame is
    written as Parquet to the shared checkpoint folder: both models and every
    report read it, and a lost executor then recomputes nothing upstream.
    """
    split = materialize(split_dataset(ds, key, sample_fraction, seed=seed), "model-split")
    train = split.filter(~F.col(SPLIT_COL))
    test = split.filter(F.col(SPLIT_COL))
    linear = fit_linear(train)
    test = test.withColumn(PRED0, linear.predict())
    if with_forest:
        forest = fit_forest(train, LABEL, NUM_FEATURES, CAT_FEATURES, key, seed=seed, **(forest_params or {}))
        # written: the metrics and every residual report read the predictions
        test = materialize(predict(forest, test, NUM_FEATURES, CAT_FEATURES, PRED1), "predictions")
    return linear, test
