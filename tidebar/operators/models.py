"""Regressors, stacking, tuning and weights (V4, V5, M1–M13) on Spark ML and aggregates."""

from __future__ import annotations


from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.operators.features import SEQUENCE_FEATURES, flat_vector
from tidebar.plans.joins import join_configured

# Fixed default parameters of the models.
MODEL_PARAMS = {
    "random_forest": {"trees": 200, "depth": 12},
    "gradient_boosting": {"trees": 200, "depth": 4, "rate": 0.1},
    "boosted_alt": {"trees": 200, "depth": 4, "rate": 0.1},
    "extra_trees": {"trees": 150, "depth": 10},
    "boosted_depth6": {"trees": 150, "depth": 6, "rate": 0.1},
    "ridge": {"alpha": 1.0},
}
SEED = 42


def vectorise(features, out: str = "features") -> VectorAssembler:
    """feature columns as one model vector."""
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error")


def _columns(label: str, prediction: str) -> dict:
    return {"featuresCol": "features", "labelCol": label, "predictionCol": prediction}


def random_forest(label="target", prediction="prediction", trees=200, depth=12, seed=SEED):
    """M1."""
    return RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed, **_columns(label, prediction))


def gradient_boosting(label="target", prediction="prediction", trees=200, depth=4, rate=0.1, seed=SEED):
    """M2."""
    return GBTRegressor(maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed, **_columns(label, prediction))


def boosted_alt(label="target", prediction="prediction", trees=200, depth=4, rate=0.1, seed=SEED):
    """M3: boosted trees on row and column samples."""
    return GBTRegressor(
        maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, featureSubsetStrategy="0.8",
        seed=seed, **_columns(label, prediction),
    )


def extra_trees(label="target", prediction="prediction", trees=150, depth=10, seed=SEED):
    """M4: no bootstrap, a random third of the features and few split points per node."""
    return RandomForestRegressor(
        numTrees=trees, maxDepth=depth, bootstrap=False, maxBins=8, featureSubsetStrategy="onethird",
        seed=seed, **_columns(label, prediction),
    )


def boosted_depth6(label="target", prediction="prediction", trees=150, depth=6, rate=0.1, seed=SEED):
    """M5."""
    return gradient_boosting(label, prediction, trees, depth, rate, seed)


BASE_MODELS = {
    "random_forest": random_forest,
    "gradient_boosting": gradient_boosting,
    "boosted_alt": boosted_alt,
    "extra_trees": extra_trees,
    "boosted_depth6": boosted_depth6,
}


def ridge_meta(df: DataFrame, inputs: list[str], label="target", prediction="prediction", alpha: float = 1.0) -> PipelineModel:
    """M6: ridge regression with an unscaled penalty ``alpha`` on the coefficients.

    Spark divides the squared error by the row count and the penalty by the
    deviation of the label, so both are undone in ``regParam``.
    """
    stats = df.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("s")).first()
    model = LinearRegression(
        elasticNetParam=0.0, regParam=alpha * (stats["s"] or 0.0) / max(stats["n"], 1), standardization=False,
        solver="normal", **_columns(label, prediction),
    )
    return Pipeline(stages=[vectorise(inputs), model]).fit(df)


def linear_meta(df: DataFrame, inputs: list[str], label="target", prediction="prediction") -> PipelineModel:
    """M7: ordinary least squares."""
    model = LinearRegression(solver="normal", **_columns(label, prediction))
    return Pipeline(stages=[vectorise(inputs), model]).fit(df)


def coefficients(spark, model: PipelineModel, inputs: list[str]) -> DataFrame:
    """Intercept and coefficients of a fitted linear stage, one row each."""
    linear = model.stages[-1]
    rows = [("intercept", float(linear.intercept))]
    rows += [(name, float(w)) for name, w in zip(inputs, linear.coefficients)]
    return spark.createDataFrame(rows, "term string, weight double")


def sequence_vectors(df: DataFrame, features=SEQUENCE_FEATURES) -> DataFrame:
    """Windows of a sequence table as ``features`` vectors."""
    return df.withColumn("features", array_to_vector(flat_vector("sequence", features))).drop("sequence")


def sequence_regressor(df: DataFrame, regressor=None, features=SEQUENCE_FEATURES, label="target") -> tuple[PipelineModel, DataFrame]:
    """M8: predict from the whole window of a sequence table; returns the model and its vectors."""
    vectors = sequence_vectors(df, features)
    regressor = regressor or LinearRegression(solver="l-bfgs", regParam=0.001, **_columns(label, "prediction"))
    return Pipeline(stages=[regressor]).fit(vectors), vectors


def out_of_fold(
    df: DataFrame, regressor, features, fold: str = "fold", folds: int = 5, prediction: str = "prediction",
    keep: tuple[str, ...] = ("series", "ts"),
) -> DataFrame:
    """Predictions of every row by a model that has not seen its fold."""
    rows = vectorise(features).transform(df)
    out = None
    for k in range(folds):
        model = regressor.copy({regressor.predictionCol: prediction}).fit(rows.where(F.col(fold) != k))
        part = model.transform(rows.where(F.col(fold) == k)).select(*keep, prediction)
        out = part if out is None else out.unionByName(part)
    return out


def train_and_stack(
    df: DataFrame, features, regressors: dict, label: str = "target", fold: str = "fold", folds: int = 5,
    keys: tuple[str, ...] = ("series", "ts"), alpha: float = 1.0, stage=None,
) -> tuple[dict[str, PipelineModel], PipelineModel, DataFrame]:
    """M9: base models, and a ridge on their out-of-fold predictions joined by key.

    Returns the base models fitted on all rows, the meta model, and the table
    of out-of-fold predictions with the stacked one.
    """
    table = df.select(*keys, label)
    models = {}
    for name, regressor in regressors.items():
        oof = out_of_fold(df, regressor, features, fold, folds, name, keys)
        table = table.join(oof, list(keys))
        fitted = regressor.copy({regressor.predictionCol: name})
        models[name] = Pipeline(stages=[vectorise(features), fitted]).fit(df)
    if stage:
        table = stage(table, "oof")
    meta = ridge_meta(table, list(regressors), label, "stacked", alpha)
    return models, meta, meta.transform(table).drop("features")


def predict_stack(df: DataFrame, models: dict[str, Transformer], meta: Transformer) -> DataFrame:
    """Base predictions as columns, then the stacked one; F7 turns it back into prices."""
    for model in models.values():
        df = model.transform(df).drop("features")
    return meta.transform(df).drop("features")


def grid_search(
    df: DataFrame, regressor, grid: dict[str, list], features, label: str = "target", folds: int = 3,
    fold_col: str | None = None, parallelism: int = 4,
) -> tuple[PipelineModel, DataFrame]:
    """V4: exhaustive search by mean squared error; returns the best model and all scores."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(getattr(regressor, name), values)
    maps = builder.build()
    evaluator = RegressionEvaluator(labelCol=label, predictionCol=regressor.getPredictionCol(), metricName="mse")
    search = CrossValidator(
        estimator=Pipeline(stages=[vectorise(features), regressor]),
        estimatorParamMaps=maps,
        evaluator=evaluator,
        numFolds=folds,
        parallelism=parallelism,
        seed=SEED,
        **({"foldCol": fold_col} if fold_col else {}),
    ).fit(df)
    rows = [
        (", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda e: e[0].name)), float(s))
        for m, s in zip(maps, search.avgMetrics)
    ]
    scores = df.sparkSession.createDataFrame(rows, "params string, mse double")
    return search.bestModel, scores


def train_or_tune(df: DataFrame, regressor, features, params: dict | None, grid: dict[str, list], label: str = "target") -> PipelineModel:
    """V5: fit with the given parameters, or search the grid when there are none."""
    if params:
        named = {getattr(regressor, k): v for k, v in params.items()}
        return Pipeline(stages=[vectorise(features), regressor.copy(named)]).fit(df)
    return grid_search(df, regressor, grid, features, label)[0]


def weighted_combine(weights: dict[str, float]) -> Column:
    """Fixed weights on prediction columns."""
    terms = [F.lit(float(w)) * F.col(c) for c, w in weights.items()]
    return sum(terms[1:], terms[0])


def combine_long(predictions: DataFrame, weights: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """M11 on long predictions and a weight table (horizon, model, w); a prediction without a weight is an error."""
    joined = join_configured(predictions, weights, ("horizon", "model"), "left")
    missing = F.raise_error(F.concat_ws(" ", F.lit("no weight for"), "model", "horizon")).cast("double")
    w = F.when(F.col("w").isNull(), missing).otherwise(F.col("w"))
    return joined.groupBy(*keys, "horizon").agg(F.sum(w * F.col("predicted")).alias("predicted"))


def regression_line(df: DataFrame, x: str, y: str, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Least-squares line per keys as one aggregate."""
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")
    )
