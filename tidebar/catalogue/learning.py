"""Queries of the regressors, stacking and tuning."""

from __future__ import annotations

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tidebar.catalogue import query
from tidebar.catalogue.cleaning import frame
from tidebar.catalogue.common import ctes, full, over, rnd, rounded
from tidebar.catalogue.evaluation import wide_predictions
from tidebar.functions.scalars import series_key
from tidebar.operators import clean as C
from tidebar.operators import evaluate as E
from tidebar.operators import features as X
from tidebar.operators import models as M
from tidebar.operators import splits as V
from tidebar.operators.window_ridge import window_ridge
from tidebar.plans import inputs as I
from tidebar.session import checkpoints, new_path, stage, stage_once
from tidebar.sources import store as K

# Stacks and grids train dozens of ensembles; theirs are small ones. Single models have their default sizes.
SMALL = {"trees": 10, "depth": 4}
FEATURES = ("close", "close_lag_1", "close_lag_2", "close_lag_3", "close_ma_5", "close_ma_10", "close_ma_15", "hour")


def training(spark, sf):
    """Hourly bars with lags, averages, the next close, a split and a fold; stored once."""

    def build():
        rows = X.lags_and_averages(I.bars_h(spark, sf), I.H).withColumn("hour", F.hour("ts").cast("double"))
        rows = X.forward_target(rows, I.H, 1).na.drop()
        key = series_key("series", "ts")
        return rows.withColumns({"split": V.random_split(key), "fold": V.kfold(key)})

    return stage_once(spark, f"{sf}/training_h", build)


def _fit_and_score(spark, sf, regressor):
    checkpoints(spark)  # boosting cuts its lineage there every ten rounds
    rows = M.vectorise(FEATURES).transform(training(spark, sf))
    model = regressor.fit(rows.where(F.col("split") == "train"))
    scored = model.transform(rows.where(F.col("split") == "test"))
    aggs = E.error_metrics("target", "prediction")
    return scored.groupBy("series").agg(*[a.alias(n) for n, a in aggs.items()], F.count(F.lit(1)).alias("n"))


@query("random_forest")
def q_random_forest(spark, sf):
    return _fit_and_score(spark, sf, M.random_forest())


@query("gradient_boosting")
def q_gradient_boosting(spark, sf):
    return _fit_and_score(spark, sf, M.gradient_boosting())


@query("boosted_alt")
def q_boosted_alt(spark, sf):
    return _fit_and_score(spark, sf, M.boosted_alt())


@query("extra_trees")
def q_extra_trees(spark, sf):
    return _fit_and_score(spark, sf, M.extra_trees())


@query("boosted_depth6")
def q_boosted_depth6(spark, sf):
    return _fit_and_score(spark, sf, M.boosted_depth6())


_META = {
    "p0": f"""SELECT series, ts, lag(close, 1) OVER {over()} AS m1, {full('avg', 'close', 20)} AS m3, {full('avg', 'close', 5)} AS m2,
        lag(close, 3) OVER {over()} AS m4, lead(close, 24) OVER {over()} AS y FROM bars_h""",
    "p": "SELECT * FROM p0 WHERE y IS NOT NULL AND m3 IS NOT NULL",
    "c": "SELECT count(*) AS n, avg(m1) AS a1, avg(m3) AS a3, avg(y) AS ay FROM p",
    "g": """SELECT sum((m1 - a1) * (m1 - a1)) + {0} AS s11, sum((m3 - a3) * (m3 - a3)) + {0} AS s33, sum((m1 - a1) * (m3 - a3)) AS s13,
        sum((m1 - a1) * (y - ay)) AS t1, sum((m3 - a3) * (y - ay)) AS t3 FROM p, c""",
    "w": """SELECT (t1 * s33 - t3 * s13) / (s11 * s33 - s13 * s13) AS w1, (t3 * s11 - t1 * s13) / (s11 * s33 - s13 * s13) AS w3 FROM g""",
}


def _meta_sql(alpha):
    parts = {k: v.format(alpha) for k, v in _META.items()}
    return (
        ctes("bars_h", **parts)
        + """SELECT 'm1' AS term, round(w1, 6) AS weight FROM w UNION ALL SELECT 'm3', round(w3, 6) FROM w
        UNION ALL SELECT 'intercept', round(ay - w1 * a1 - w3 * a3, 4) FROM w, c"""
    )


def _meta(spark, sf, fit):
    rows = wide_predictions(spark, sf, (24,)).withColumnRenamed("actual", "target")
    model = fit(rows, ["m1", "m3"])
    out = M.coefficients(spark, model, ["m1", "m3"])
    places = F.when(F.col("term") == "intercept", F.round("weight", 4)).otherwise(F.round("weight", 6))
    return out.select("term", places.alias("weight"))


@query("ridge_meta", _meta_sql("500.0"))
def q_ridge(spark, sf):
    return _meta(spark, sf, lambda rows, names: M.ridge_meta(rows, names, alpha=500.0))


@query("linear_meta", _meta_sql("0.0"))
def q_linear(spark, sf):
    return _meta(spark, sf, M.linear_meta)


SEQUENCE = ("close", "high", "low", "open", "volume")


@query("sequence_regressor")
def q_sequence_regressor(spark, sf):
    bars = I.bars_15m_all(spark, sf)
    rows = stage_once(spark, f"{sf}/sequences", lambda: X.sequences(bars, I.Q, SEQUENCE, steps=1))
    split = V.chronological_split(rows.select("series", "ts"), I.Q)
    rows = rows.join(split, ["series", "ts"])
    model, _ = M.sequence_regressor(rows.where("split = 'train'"), features=SEQUENCE)
    scored = model.transform(M.sequence_vectors(rows.where("split = 'test'"), SEQUENCE))
    scored = X.inverse_scale(scored, "prediction", "close", X.scaler(bars, ["close"]), "predicted")
    scored = X.inverse_scale(scored, "target", "close", X.scaler(bars, ["close"]), "actual")
    return scored.groupBy("series").agg(*[a.alias(n) for n, a in E.error_metrics().items()])


def _stack(spark, sf):
    checkpoints(spark)
    bases = {name: build(trees=5, depth=4) for name, build in M.BASE_MODELS.items()}
    bases["linear"] = LinearRegression(featuresCol="features", labelCol="target")
    rows = training(spark, sf).where(F.col("split") == "train")
    return M.train_and_stack(rows, FEATURES, bases, folds=5, stage=stage)


@query("train_and_stack")
def q_train_and_stack(spark, sf):
    _, _, table = _stack(spark, sf)
    names = [*M.BASE_MODELS, "linear", "stacked"]
    long = table.unpivot(["series", "ts", "target"], names, "model", "predicted")
    return E.metrics_by(long, ("model",), "target")


@query("predict_stack")
def q_predict_stack(spark, sf):
    models, meta, _ = _stack(spark, sf)
    rows = training(spark, sf).where(F.col("split") == "test")
    out = M.predict_stack(rows, models, meta)
    return out.select("series", "ts", "target", *models, "stacked")


def _sequence_fit(spark, sf, horizon, steps):
    bars = I.bars_15m_all(spark, sf)
    split = V.chronological_split(bars, I.Q)
    train = split.where(F.col("split") == "train").drop("split")
    test = split.where(F.col("split") == "test").drop("split")
    fitted = X.scaler(train, SEQUENCE)
    seqs = stage(X.sequences(train, I.Q, SEQUENCE, steps=steps, fitted=fitted), "train")
    model, _ = M.sequence_regressor(seqs, features=SEQUENCE)
    ahead = stage(X.sequences(test, I.Q, SEQUENCE, steps=steps, fitted=fitted), "test")
    vectors = ahead.withColumn("features", M.array_to_vector(X.flat_vector("sequence", SEQUENCE))).drop("sequence")
    out = X.inverse_scale(model.transform(vectors), "prediction", "close", fitted, "predicted")
    out = X.inverse_scale(out, "target", "close", fitted, "actual")
    return out.select(F.lit(horizon).alias("horizon"), "series", "ts", "actual", "predicted")


@query("train_by_horizon")
def q_train_by_horizon(spark, sf):
    """Sequence model per market-hours horizon: train on the first 75 %, score the rest."""
    out = None
    for horizon, steps in X.HORIZONS_MARKET.items():
        part = _sequence_fit(spark, sf, horizon, steps)
        out = part if out is None else out.unionByName(part)
    aggs = {**E.error_metrics(), **E.spread_interval()}
    return out.groupBy("horizon").agg(*[a.alias(n) for n, a in aggs.items()])


GRID = {"maxDepth": [2, 4], "numTrees": [3, 6]}


@query("grid_search")
def q_grid_search(spark, sf):
    rows = training(spark, sf).where(F.col("split") == "train").withColumn("cv", F.col("fold") % 3)
    return M.grid_search(rows, M.random_forest(**SMALL), GRID, FEATURES, fold_col="cv")[1]


@query("train_or_tune")
def q_train_or_tune(spark, sf):
    rows = training(spark, sf)
    train, test = rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test")
    given = M.train_or_tune(train, M.random_forest(**SMALL), FEATURES, {"maxDepth": 3, "numTrees": 4}, GRID)
    tuned = M.train_or_tune(train, M.random_forest(**SMALL), FEATURES, None, {"maxDepth": [2, 4]})
    parts = [m.transform(test).select("target", "prediction", F.lit(n).alias("how")) for n, m in (("given", given), ("tuned", tuned))]
    e = E.error_metrics("target", "prediction")
    return parts[0].unionByName(parts[1]).groupBy("how").agg(e["mae"].alias("mae"), e["rmse"].alias("rmse"))


@query(
    "save_models",
    ctes("bars_h") + "SELECT series, greatest(count(*) - 15, 0) AS n, true AS same FROM bars_h GROUP BY series HAVING count(*) > 15",
)
def q_save_models(spark, sf):
    rows = training(spark, sf)
    model = M.train_or_tune(rows.where(F.col("split") == "train"), M.random_forest(**SMALL), FEATURES, {"maxDepth": 3}, GRID)
    path = new_path(spark, "model")
    assert K.load_model(path) is None
    K.save_model(model, path)
    loaded = K.load_model(path)
    a = model.transform(rows).select("series", "ts", F.col("prediction").alias("before"))
    b = loaded.transform(rows).select("series", "ts", F.col("prediction").alias("after"))
    both = a.join(b, ["series", "ts"])
    return both.groupBy("series").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("before") == F.col("after")).alias("same")
    )


# -- ridge on whole windows ------------------------------------------------------


def _window_rows(spark, sf):
    """The five sequence features of the hourly frame, scaled on the first three quarters of each series."""
    rows = frame(spark, sf).select("series", "ts", *C.SEQUENCE_FEATURES)
    fitted = X.scaler(V.chronological_split(rows, I.H).where("split = 'train'"), list(C.SEQUENCE_FEATURES))
    scaled = X.minmax_scale(rows, list(C.SEQUENCE_FEATURES), fitted)
    scaled = scaled.select("series", "ts", *(F.col(f"{c}_scaled").alias(c) for c in C.SEQUENCE_FEATURES))
    return stage_once(spark, f"{sf}/window_rows", lambda: scaled), fitted


@query("window_ridge")
def q_window_ridge(spark, sf):
    """Windows of 48 rows and five features, errors in prices, on training and held-out windows."""
    rows, fitted = _window_rows(spark, sf)
    out = window_ridge(rows, I.H, C.SEQUENCE_FEATURES)
    for c in ("actual", "predicted"):
        out = X.inverse_scale(out, c, "close", fitted, c)
    e = E.error_metrics()
    return rounded(out.groupBy("series", "split").agg(e["mae"].alias("mae"), e["rmse"].alias("rmse"), F.count(F.lit(1)).alias("n")))


_SHORT = {
    "b": f"""SELECT series, ts, row_number() OVER {over()} - 1 AS pos, count(*) OVER (PARTITION BY series) AS n,
        close / 100 AS x0, lag(close / 100) OVER {over()} AS x1, lead(close / 100, 26) OVER {over()} AS y FROM bars_h""",
    "t": "SELECT * FROM b WHERE pos >= 1 AND pos < floor(0.75 * n) - 26",
    # normal equations of two lags with a ridge of 1
    "m": """SELECT series, avg(x0) AS a0, avg(x1) AS a1, avg(y) AS ay, var_pop(x0) * count(*) + 1 AS c00, covar_pop(x0, x1) * count(*) AS c01,
        var_pop(x1) * count(*) + 1 AS c11, covar_pop(x0, y) * count(*) AS v0, covar_pop(x1, y) * count(*) AS v1 FROM t GROUP BY 1""",
    "w": "SELECT *, (v0 * c11 - v1 * c01) / (c00 * c11 - c01 * c01) AS w0, (v1 * c00 - v0 * c01) / (c00 * c11 - c01 * c01) AS w1 FROM m",
}


@query(
    "window_ridge_short",
    ctes("bars_h", **_SHORT)
    + f"""SELECT b.series, b.ts, b.pos AS row, CASE WHEN pos < floor(0.75 * n) - 26 THEN 'train' ELSE 'test' END AS split,
        {rnd('y AS actual', 'ay + w0 * (x0 - a0) + w1 * (x1 - a1) AS predicted')} FROM b JOIN w ON w.series = b.series
        WHERE pos >= 1 AND y IS NOT NULL AND (pos < floor(0.75 * n) - 26 OR pos >= floor(0.75 * n))""",
)
def q_window_ridge_short(spark, sf):
    rows = I.bars_h(spark, sf).select("series", "ts", (F.col("close") / 100).alias("close"))
    return rounded(window_ridge(rows, I.H, ("close",), length=2))
