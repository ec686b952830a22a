"""Evaluation of predictions (E1–E9). All are aggregates with partial steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.plans import zones
from tidebar.plans.joins import join_per_key
from tidebar.plans.zones import Order

INTERVAL_LEVEL = 0.75  # fixed default


def error_metrics(actual: str = "actual", predicted: str = "predicted") -> dict[str, Column]:
    """MAE, RMSE and mean absolute difference (equal to MAE)."""
    d = F.col(actual) - F.col(predicted)
    return {"mae": F.avg(F.abs(d)), "rmse": F.sqrt(F.avg(d * d)), "avg_diff": F.avg(F.abs(d))}


def spread_interval(predicted: str = "predicted", level: float = INTERVAL_LEVEL) -> dict[str, Column]:
    """Mean ± level times the population deviation of the predictions."""
    mean, margin = F.avg(predicted), F.stddev_pop(predicted) * level
    return {"ci_low": mean - margin, "ci_high": mean + margin}


def metrics_by(
    df: DataFrame, keys: tuple[str, ...] = ("model", "horizon"), actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """E1 and E2 per group in one aggregate."""
    aggs = {**error_metrics(actual, predicted), **spread_interval(predicted)}
    return df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])


def fold_average(df: DataFrame, keys: tuple[str, ...] = ("model", "horizon"), fold: str = "fold") -> DataFrame:
    """Metrics per fold, then their mean over the folds."""
    per_fold = metrics_by(df, (*keys, fold))
    names = ("mae", "rmse", "ci_low", "ci_high")
    return per_fold.groupBy(*keys).agg(
        *[F.avg(n).alias(n) for n in names], F.count(F.lit(1)).alias("folds")
    )


def coverage(actual: str = "actual", low: str = "low", high: str = "high") -> Column:
    """E5: share of actual values inside the interval."""
    return F.avg(F.col(actual).between(F.col(low), F.col(high)).cast("double"))


def classification_metrics(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Accuracy and support-weighted precision and recall of rounded scores.

    Scores are rounded half to even. A class nobody predicted has precision 0.
    The confusion counts are the only rows that are shuffled.
    """
    df = df.select(F.col(label).cast("int").alias("_y"), F.bround(score).cast("int").alias("_p"))
    cells = df.groupBy("_y", "_p").agg(F.count(F.lit(1)).alias("_k"))
    classes = cells.select(
        "_k", F.inline(F.array(
            F.struct(F.col("_y").alias("cls"), F.col("_k").alias("support"), F.lit(0).cast("long").alias("chosen")),
            F.struct(F.col("_p").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("_k").alias("chosen")),
        )), (F.col("_y") == F.col("_p")).alias("_hit"),
    )
    per_class = classes.groupBy("cls").agg(
        F.sum("support").alias("support"),
        F.sum("chosen").alias("chosen"),
        F.sum(F.when(F.col("_hit") & (F.col("support") > 0), F.col("_k")).otherwise(0)).alias("hits"),
    )
    total = F.sum("support")
    precision = F.coalesce(F.try_divide(F.col("hits"), F.col("chosen")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("hits"), F.col("support")), F.lit(0.0))
    return per_class.agg(
        (F.sum("hits") / total).alias("accuracy"),
        (F.sum(precision * F.col("support")) / total).alias("precision"),
        (F.sum(recall * F.col("support")) / total).alias("recall"),
        total.alias("n"),
    )


def shifted_error(
    df: DataFrame, order: Order, shift: int = 25, actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """Errors after moving the predictions ``shift`` rows earlier; 0 keeps all rows."""
    if shift:
        df = zones.over(df, order, after=shift, _moved=lambda w: F.lead(predicted, shift).over(w))
        df = df.withColumn(predicted, F.col("_moved")).drop("_moved")
    aggs = error_metrics(actual, predicted)
    return df.where(F.col(predicted).isNotNull()).groupBy(*order.keys).agg(
        *[a.alias(n) for n, a in aggs.items()], F.count(F.lit(1)).alias("n")
    )


def predicted_vs_actual(df: DataFrame, keys: tuple[str, ...] = ("series",), level: float = INTERVAL_LEVEL) -> DataFrame:
    """The rows behind a plot: time, actual, predicted and the interval of the group."""
    band = df.groupBy(*keys).agg(*[a.alias(n) for n, a in spread_interval(level=level).items()])
    return join_per_key(df, band, keys).select(
        *keys, "ts", "actual", "predicted", F.col("ci_low").alias("low"), F.col("ci_high").alias("high")
    )


def best_model(metrics: DataFrame, key: str = "horizon", metric: str = "mae") -> DataFrame:
    """Model with the lowest error per key; ties go to the first name."""
    return metrics.groupBy(key).agg(
        F.min_by("model", F.struct(metric, "model")).alias("model"), F.min(metric).alias(metric)
    )
