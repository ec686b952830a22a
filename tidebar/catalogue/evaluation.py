"""Queries of evaluation and fixed or optimised weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.catalogue import query
from tidebar.catalogue.common import HASH, KEY, ctes, full, over, rnd, rounded
from tidebar.functions.scalars import key_hash, series_key
from tidebar.operators import evaluate as E
from tidebar.operators import models as M
from tidebar.operators import weights as W
from tidebar.operators.features import horizon_targets, inline_targets
from tidebar.operators.indicators import sma
from tidebar.operators.splits import kfold
from tidebar.plans import inputs as I
from tidebar.plans import zones
from tidebar.plans.joins import join_configured
from tidebar.plans.zones import Order

MODELS = ["m1", "m2", "m3", "m4"]
SIX = [*MODELS, "m5", "m6"]
HORIZONS = (12, 24, 36, 48, 72, 96)


def wide_predictions(spark, sf, horizons=HORIZONS, models=MODELS):
    """Simple forecasts per bar and horizon: lags 1, 3 and 6, averages of 5, 20 and 10."""
    bars = I.bars_h(spark, sf).select("series", "ts", "close")
    z = zones.enter(bars, I.H, before=20, after=max(horizons))
    w = zones.window(I.H)
    z = z.withColumns(
        {
            "m1": F.lag("close", 1).over(w),
            "m2": sma("close", w, 5),
            "m3": sma("close", w, 20),
            "m4": F.lag("close", 3).over(w),
            "m5": F.lag("close", 6).over(w),
            "m6": sma("close", w, 10),
            "_targets": horizon_targets(w, {str(h): h for h in horizons}, "close", "actual"),
        }
    )
    out = inline_targets(zones.leave(z), "actual").na.drop(subset=models)
    return out.select("series", "ts", "close", *models, "horizon", "actual")


def long_predictions(spark, sf, horizons=HORIZONS):
    wide = wide_predictions(spark, sf, horizons)
    return wide.unpivot(["series", "ts", "close", "horizon", "actual"], MODELS, "model", "predicted")


_WIDE = {
    "p0": f"""SELECT series, ts, close, lag(close, 1) OVER {over()} AS m1, {full('avg', 'close', 5)} AS m2,
        {full('avg', 'close', 20)} AS m3, lag(close, 3) OVER {over()} AS m4, lag(close, 6) OVER {over()} AS m5, {full('avg', 'close', 10)} AS m6,
        {', '.join(f"lead(close, {h}) OVER {over()} AS a{h}" for h in HORIZONS)} FROM bars_h""",
    "wide": " UNION ALL ".join(
        f"SELECT series, ts, close, '{h}' AS horizon, a{h} AS actual, m1, m2, m3, m4 FROM p0 WHERE a{h} IS NOT NULL AND m3 IS NOT NULL"
        for h in HORIZONS
    ),
}
_LONG = {
    **_WIDE,
    "long": " UNION ALL ".join(
        f"SELECT series, ts, close, horizon, actual, '{m}' AS model, {m} AS predicted FROM wide" for m in MODELS
    ),
}
_MAE = "avg(abs(actual - predicted)) AS mae"
_RMSE = "sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse"
_CI = "avg(predicted) - 0.75 * stddev_pop(predicted) AS ci_low|avg(predicted) + 0.75 * stddev_pop(predicted) AS ci_high".split("|")


@query(
    "error_metrics",
    ctes("bars_h", **_LONG)
    + f"SELECT series, {rnd(_MAE, _RMSE, 'avg(abs(actual - predicted)) AS avg_diff')} FROM long GROUP BY series",
)
def q_errors(spark, sf):
    rows = long_predictions(spark, sf)
    return rounded(rows.groupBy("series").agg(*[a.alias(n) for n, a in E.error_metrics().items()]))


@query("spread_interval", ctes("bars_h", **_LONG) + f"SELECT model, {rnd(*_CI)} FROM long GROUP BY model")
def q_spread(spark, sf):
    rows = long_predictions(spark, sf)
    return rounded(rows.groupBy("model").agg(*[a.alias(n) for n, a in E.spread_interval().items()]))


@query(
    "metrics_by_model_horizon",
    ctes("bars_h", **_LONG)
    + f"SELECT model, horizon, {rnd(_MAE, _RMSE, 'avg(abs(actual - predicted)) AS avg_diff', *_CI)} FROM long GROUP BY model, horizon",
)
def q_metrics(spark, sf):
    return rounded(E.metrics_by(long_predictions(spark, sf)))


@query(
    "fold_average",
    ctes(
        "bars_h",
        **_LONG,
        f=f"SELECT model, horizon, {HASH.format(KEY)} % 5 AS fold, {_MAE}, {_RMSE}, {', '.join(_CI)} FROM long GROUP BY 1, 2, 3",
    )
    + f"""SELECT model, horizon, {rnd('avg(mae) AS mae', 'avg(rmse) AS rmse', 'avg(ci_low) AS ci_low', 'avg(ci_high) AS ci_high')},
        count(*) AS folds FROM f GROUP BY 1, 2""",
)
def q_folds(spark, sf):
    rows = long_predictions(spark, sf).withColumn("fold", kfold(series_key("series", "ts")))
    return rounded(E.fold_average(rows))


@query(
    "coverage",
    ctes("bars_h", **_LONG, c=f"SELECT model, horizon, {', '.join(_CI)} FROM long GROUP BY 1, 2")
    + """SELECT model, horizon, round(avg((actual BETWEEN ci_low AND ci_high)::INTEGER), 6) AS coverage
        FROM long JOIN c USING (model, horizon) GROUP BY 1, 2""",
)
def q_coverage(spark, sf):
    rows = E.predicted_vs_actual(long_predictions(spark, sf), ("model", "horizon"))
    return rounded(rows.groupBy("model", "horizon").agg(E.coverage().alias("coverage")))


@query(
    "classification_metrics",
    f"""WITH l AS (SELECT quality AS y, round_even(({HASH.format('doc_id')} % 101) / 100, 0)::INTEGER AS p FROM labels),
       k AS (SELECT c.c, (SELECT count(*) FROM l WHERE y = c.c) AS s, (SELECT count(*) FROM l WHERE p = c.c) AS q,
                (SELECT count(*) FROM l WHERE y = c.c AND p = c.c) AS t FROM (SELECT y AS c FROM l UNION SELECT p FROM l) c)
       SELECT round(sum(t) / sum(s), 6) AS accuracy, round(sum(coalesce(t / nullif(q, 0), 0) * s) / sum(s), 6) AS precision,
         round(sum(coalesce(t / nullif(s, 0), 0) * s) / sum(s), 6) AS recall, sum(s)::BIGINT AS n FROM k""",
)
def q_classification(spark, sf):
    rows = I.table(spark, sf, "labels").select(
        F.col("quality").alias("label"), (key_hash("doc_id") % 101 / 100).alias("score")
    )
    return rounded(E.classification_metrics(rows))


def _shift_sql(k):
    return ctes(
        "bars_h", **_WIDE, s=f"SELECT series, horizon, actual, lead(m1, {k}) OVER (PARTITION BY series, horizon ORDER BY ts) AS predicted FROM wide"
    ) + f"""SELECT series, horizon, {rnd(_MAE, _RMSE, 'avg(abs(actual - predicted)) AS avg_diff')}, count(*) AS n
        FROM s WHERE predicted IS NOT NULL GROUP BY series, horizon"""


def _shifted(spark, sf, k):
    rows = wide_predictions(spark, sf).select("series", "horizon", "ts", "actual", F.col("m1").alias("predicted"))
    return rounded(E.shifted_error(rows, Order(3600, ("series", "horizon")), k))


@query("shifted_error", _shift_sql(25))
def q_shifted(spark, sf):
    return _shifted(spark, sf, 25)


@query("shifted_error_zero", _shift_sql(0))
def q_shifted_zero(spark, sf):
    return _shifted(spark, sf, 0)


@query(
    "predicted_vs_actual",
    ctes("bars_h", **_LONG, c=f"SELECT model, horizon, {', '.join(_CI)} FROM long GROUP BY 1, 2")
    + f"SELECT model, horizon, series, ts, actual, {rnd('predicted', 'ci_low AS low', 'ci_high AS high')} FROM long JOIN c USING (model, horizon)",
)
def q_plot_rows(spark, sf):
    rows = long_predictions(spark, sf)
    band = E.metrics_by(rows).select("model", "horizon", F.col("ci_low").alias("low"), F.col("ci_high").alias("high"))
    return rounded(join_configured(rows, band, ("model", "horizon")).select("model", "horizon", "series", "ts", "actual", "predicted", "low", "high"))


@query(
    "best_model",
    ctes("bars_h", **_LONG, e=f"SELECT model, horizon, {_MAE} FROM long GROUP BY 1, 2")
    + "SELECT horizon, first(model ORDER BY round(mae, 9), model) AS model, round(min(mae), 6) AS mae FROM e GROUP BY horizon",
)
def q_best(spark, sf):
    m = E.metrics_by(long_predictions(spark, sf)).withColumn("mae", F.round("mae", 9))
    return rounded(E.best_model(m))


# -- weights -------------------------------------------------------------------


@query(
    "weighted_combine",
    ctes("bars_h", **_WIDE)
    + f"""SELECT series, ts, horizon, {rnd('0.4 * m1 + 0.3 * m2 + 0.3 * m3 AS stacked',
        '0.5 * (0.4 * m1 + 0.3 * m2 + 0.3 * m3) + 0.25 * m4 + 0.25 * m3 AS combined')}, round(m4, 6) AS sequence_only FROM wide""",
)
def q_weighted(spark, sf):
    rows = wide_predictions(spark, sf).withColumn("stacked", M.weighted_combine({"m1": 0.4, "m2": 0.3, "m3": 0.3}))
    rows = rows.withColumn("combined", M.weighted_combine({"stacked": 0.5, "m4": 0.25, "m3": 0.25}))
    rows = rows.withColumn("sequence_only", M.weighted_combine({"stacked": 0.0, "m4": 1.0}))
    return rounded(rows.select("series", "ts", "horizon", "stacked", "combined", "sequence_only"))


@query(
    "weighted_combine_long",
    ctes("bars_h", **_LONG, e=f"SELECT model, horizon, {_MAE} FROM long GROUP BY 1, 2", t="SELECT horizon, sum(1 / mae) AS s FROM e GROUP BY 1")
    + """SELECT series, ts, horizon, round(sum(predicted / mae / s), 6) AS predicted
        FROM long JOIN e USING (model, horizon) JOIN t USING (horizon) GROUP BY 1, 2, 3""",
)
def q_weighted_long(spark, sf):
    rows = long_predictions(spark, sf)
    e = E.metrics_by(rows).select("model", "horizon", (1 / F.col("mae")).alias("v"))
    total = e.groupBy("horizon").agg(F.sum("v").alias("s"))
    weights = e.join(total, "horizon").select("model", "horizon", (F.col("v") / F.col("s")).alias("w"))
    return rounded(M.combine_long(rows, weights, ("series", "ts")))


_WIDE6 = {
    **_WIDE,
    "wide6": " UNION ALL ".join(
        f"SELECT series, ts, close, '{h}' AS horizon, a{h} AS actual, m1, m2, m3, m4, m5, m6 FROM p0 WHERE a{h} IS NOT NULL AND m3 IS NOT NULL"
        for h in HORIZONS
    ),
}
_PARTS = "abcdef"


def _grid(models, parts=10):
    """All weightings in lexicographic order, the last weight being the rest."""
    free = _PARTS[: len(models) - 1]
    rest = " - ".join([str(parts), *free])
    return f"SELECT {', '.join(free)}, {rest} AS {_PARTS[len(models) - 1]} FROM {', '.join(f'range({parts + 1}) t{x}({x})' for x in free)} WHERE {rest} >= 0"


def _weights_sql(score, keys="horizon", period="", models=SIX, source="wide6"):
    """Every weighting of the grid on every row; a weighting's error is that of the models' errors."""
    part, used = f"PARTITION BY {keys}", _PARTS[: len(models)]
    error = " + ".join(f"{x} / 10 * (actual - {m})" for x, m in zip(used, models))
    return ctes(
        "bars_h",
        **_WIDE6,
        g=_grid(models),
        pw=f"SELECT *{period} FROM {source}",
        e=f"""SELECT {keys}, {', '.join(used)}, avg(abs(err)) AS mae, sqrt(avg(err * err)) AS rmse FROM
            (SELECT {keys}, {', '.join(used)}, {error} AS err FROM pw, g) GROUP BY {keys}, {', '.join(used)}""",
        r=f"SELECT *, row_number() OVER ({part} ORDER BY round({score}, 9), {', '.join(used)}) AS k FROM e",
    ) + f"""SELECT {keys}, {', '.join(f'{x} / 10 AS w_{m}' for x, m in zip(used, models))}, {rnd('mae', 'rmse', f'{score} AS score')}
        FROM r WHERE k = 1"""


@query("optimise_weights", _weights_sql("mae"))
def q_weights_mae(spark, sf):
    return rounded(W.optimise_weights(wide_predictions(spark, sf, models=SIX), SIX, "mae", keys=("horizon",)))


@query("optimise_weights_rmse", _weights_sql("rmse"))
def q_weights_rmse(spark, sf):
    return rounded(W.optimise_weights(wide_predictions(spark, sf, models=SIX), SIX, "rmse", keys=("horizon",)))


@query("optimise_weights_hybrid", _weights_sql("(0.5 * mae + 0.5 * rmse)"))
def q_weights_hybrid(spark, sf):
    return rounded(W.optimise_weights(wide_predictions(spark, sf, models=SIX), SIX, "hybrid", keys=("horizon",)))


_FINE = """SELECT f.horizon, f.a, f.b, f.c, 50 - f.a - f.b - f.c AS d FROM
    (SELECT horizon, unnest(range(greatest(0, 5 * a - 5)::BIGINT, least(50, 5 * a + 5)::BIGINT + 1)) AS a, b, c FROM
        (SELECT horizon, a, unnest(range(greatest(0, 5 * b - 5)::BIGINT, least(50, 5 * b + 5)::BIGINT + 1)) AS b, c FROM
            (SELECT horizon, a, b, unnest(range(greatest(0, 5 * c - 5)::BIGINT, least(50, 5 * c + 5)::BIGINT + 1)) AS c FROM r WHERE k = 1))) f
    WHERE f.a + f.b + f.c <= 50"""


def _refined_sql():
    coarse = _weights_sql("mae", models=MODELS, source="wide").rpartition("SELECT horizon, a / 10")[0]
    error = " + ".join(f"{x} / 50 * (actual - {m})" for x, m in zip("abcd", MODELS))
    return coarse.rstrip() + f""", fg AS ({_FINE}),
        fe AS (SELECT horizon, a, b, c, d, avg(abs(x)) AS mae, sqrt(avg(x * x)) AS rmse
            FROM (SELECT horizon, a, b, c, d, {error} AS x FROM wide JOIN fg USING (horizon)) GROUP BY ALL),
        fr AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY round(mae, 9), a, b, c, d) AS k FROM fe)
        SELECT horizon, {', '.join(f'{x} / 50 AS w_{m}' for x, m in zip('abcd', MODELS))}, {rnd('mae', 'rmse', 'mae AS score')} FROM fr WHERE k = 1"""


@query("optimise_weights_refined", _refined_sql())
def q_weights_refined(spark, sf):
    return rounded(W.optimise_weights(wide_predictions(spark, sf), MODELS, "mae", keys=("horizon",), finer=5))


@query("optimise_weights_exact")
def q_weights_exact(spark, sf):
    return rounded(W.exact_weights(wide_predictions(spark, sf, models=SIX), SIX, keys=("horizon",)))


@query("adaptive_weights", _weights_sql("mae", "horizon, period", ", date_trunc('week', ts)::TIMESTAMP AS period"))
def q_adaptive(spark, sf):
    rows = wide_predictions(spark, sf, models=SIX).withColumn("period", F.trunc(F.col("ts").cast("date"), "week").cast("timestamp_ntz"))
    return rounded(W.optimise_weights(rows, SIX, "mae", keys=("horizon", "period")))


@query(
    "naive_forecast",
    ctes("bars_d", b=f"SELECT *, row_number() OVER {over()} - 1 AS pos, lead(close, 1) OVER {over()} AS nxt FROM bars_d")
    + f"""SELECT series, {rnd('regr_slope(nxt, close) AS slope', 'regr_intercept(nxt, close) AS intercept', 'regr_r2(nxt, close) AS r2')}
        FROM b WHERE nxt IS NOT NULL GROUP BY series""".replace(", 6)", ", 4)"),
)
def q_naive(spark, sf):
    rows = zones.over(I.bars_d(spark, sf), I.D, after=1, nxt=lambda w: F.lead("close").over(w))
    return rounded(M.regression_line(rows.where(F.col("nxt").isNotNull()), "close", "nxt"), 4)
