"""Tables on shared storage (K1–K9)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.session import exists

# Fixed default parameters per model.
DEFAULT_PARAMS = {
    "random_forest": {"trees": 200, "depth": 20, "min_split": 2, "min_leaf": 1},
    "boosted_alt": {"trees": 100, "rate": 0.2, "depth": 3, "min_child_weight": 3, "gamma": 0},
    "gradient_boosting": {"trees": 300, "rate": 0.1, "depth": 3, "min_split": 10, "min_leaf": 1},
    "sequence": {"units": 100, "dropout": 0.2, "rate": 0.01, "batch_size": 32, "epochs": 50},
}
BEST_THRESHOLD = 0.1


def overwrite_datasets(df: DataFrame, path: str, keys: tuple[str, ...] = ("dataset", "timeframe")) -> None:
    """K1: replace the partitions present in ``df``, keep all others."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def load_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """K2: the stored table, or an empty one of the same schema."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_dedup(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """K3: old and new rows, fully equal rows once."""
    both = new if old is None else old.unionByName(new)
    return both.dropDuplicates()


def append_sentiment(score: DataFrame, path: str, now: Column, column: str = "avg_sentiment") -> None:
    """K4: append (timestamp, score); the clock is an argument."""
    score.select(now.cast("timestamp_ntz").alias("timestamp"), F.col(column).alias("score")).write.mode(
        "append"
    ).parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """K5: metric rows as JSON lines."""
    metrics.write.mode("overwrite").json(path)


def best_params_gate(
    current: DataFrame, best: DataFrame, keys: tuple[str, ...], threshold: float = BEST_THRESHOLD
) -> DataFrame:
    """K6: the new metrics where both errors are within the threshold of the best, else the saved ones.

    Keys without saved metrics take the new ones.
    """
    saved = best.select(*keys, F.col("mae").alias("_mae"), F.col("rmse").alias("_rmse"))
    limit = 1 + threshold
    keep = (F.col("mae") > F.col("_mae") * limit) | (F.col("rmse") > F.col("_rmse") * limit)
    keep = F.coalesce(keep, F.lit(False))
    return current.join(saved, list(keys), "left").select(
        *keys,
        F.when(keep, "keep").otherwise("replace").alias("decision"),
        F.when(keep, F.col("_mae")).otherwise(F.col("mae")).alias("mae"),
        F.when(keep, F.col("_rmse")).otherwise(F.col("rmse")).alias("rmse"),
    )


def save_model(model: PipelineModel, path: str) -> None:
    """K7."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | None:
    """K7: the stored model, or None where nothing is stored."""
    spark = SparkSession.getActiveSession()
    return PipelineModel.load(path) if exists(spark, path) else None


def save_weights(weights: DataFrame, path: str) -> None:
    """K8: weights (horizon, model, w); the horizons in ``weights`` are replaced."""
    overwrite_datasets(weights, path, ("horizon",))


def params_table(spark: SparkSession, saved: DataFrame | None, defaults: dict = DEFAULT_PARAMS) -> DataFrame:
    """K8: parameters (model, name, value): the saved value, else the default."""
    rows = [(m, n, float(v)) for m, params in defaults.items() for n, v in params.items()]
    base = spark.createDataFrame(rows, "model string, name string, default double")
    if saved is None:
        return base.withColumnRenamed("default", "value")
    merged = base.join(saved, ["model", "name"], "full")
    return merged.select("model", "name", F.coalesce("value", "default").alias("value"))


def dataset_summary(df: DataFrame, keys: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """K9: rows per dataset, columns, and whether it is empty."""
    columns = len([c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).withColumns(
        {"n_columns": F.lit(columns), "is_empty": F.col("n_rows") == 0}
    )


def dataset_shapes(datasets: dict[str, DataFrame]) -> DataFrame:
    """K9 over differently shaped datasets; an empty one is reported with 0 rows."""
    out = None
    for name, df in datasets.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("dataset"),
            "n_rows",
            F.lit(len(df.columns)).alias("n_columns"),
            (F.col("n_rows") == 0).alias("is_empty"),
        )
        out = row if out is None else out.unionByName(row)
    return out
