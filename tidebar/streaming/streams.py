"""Streaming forms of bars, deduplication and exponential means."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.functions.scalars import epoch_seconds, event_time, total_order, wall_clock
from tidebar.operators.ewm import ewm
from tidebar.plans.joins import join_per_key
from tidebar.plans.zones import Order
from tidebar.session import stage
from tidebar.sources.bars import build_bars
from tidebar.sources.store import load_or_empty

DELAY = "10 minutes"


def stream_bars(ticks: DataFrame, interval: str, price: str = "price", ids: tuple[str, ...] = (), delay: str = DELAY) -> DataFrame:
    """Bars of a stream; a bar is final, and later ticks of it dropped, once the watermark passes it."""
    ticks = ticks.withColumn("_at", event_time("ts")).withWatermark("_at", delay)
    bars = build_bars(ticks, interval, price, ids, at="_at")
    return bars.withColumn("ts", wall_clock("ts"))


def stream_append_dedup(rows: DataFrame, keys: list[str], delay: str = DELAY) -> DataFrame:
    """First row of each key within the watermark delay."""
    rows = rows.withColumn("_at", event_time("ts")).withWatermark("_at", delay)
    return rows.dropDuplicatesWithinWatermark(keys).drop("_at")


# -- sinks that revise what they have written ------------------------------------
#
# A micro-batch writes its rows under ``batch=<id>`` and reads those of smaller ids only. A repeated batch
# replaces its own folder and finds the same state, so each row counts once however often a batch is tried.


def _stored(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    rows = load_or_empty(spark, path, T.StructType([*schema.fields, T.StructField("batch", T.LongType())]))
    return rows if before is None else rows.where(F.col("batch") < before)


def _put(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the last batch that wrote each key."""
    return rows.join(rows.groupBy(*keys).agg(F.max("batch").alias("batch")), [*keys, "batch"])


def append_once(rows: DataFrame, batch_id: int, path: str, keys: list[str]) -> None:
    """X3 for ``foreachBatch``: rows whose key no earlier batch has; one of those that share a key in this one."""
    known = _stored(rows.sparkSession, path, rows.schema, batch_id).select(*keys)
    _put(rows.dropDuplicates(keys).join(known, keys, "left_anti"), path, batch_id)


def appended(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows that :func:`append_once` has kept."""
    return _stored(spark, path, schema).drop("batch")


def _bar_parts(ticks: DataFrame, interval: str, price: str, ids: tuple[str, ...]) -> DataFrame:
    order = total_order("ts", ids)
    bar = F.window("ts", interval).start.alias("ts")
    return ticks.groupBy("series", bar).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"),
        F.count(F.lit(1)).alias("volume"), F.min(order).alias("first"), F.max(order).alias("last"),
    )


def revise_bars(ticks: DataFrame, batch_id: int, path: str, interval: str, price: str = "price", ids: tuple[str, ...] = ()) -> None:
    """X2 for ``foreachBatch``: bars of the ticks so far. A late tick revises its bar; only bars with new ticks are read and written."""
    parts = _bar_parts(ticks, interval, price, ids)
    before = _stored(ticks.sparkSession, path, parts.schema, batch_id)
    keys = ["series", "ts"]
    touched = _latest(before.join(parts.select(*keys), keys, "left_semi"), keys).drop("batch")
    merged = parts.unionByName(touched).groupBy(*keys).agg(
        F.min_by("open", "first").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "last").alias("close"),
        F.sum("volume").alias("volume"), F.min("first").alias("first"), F.max("last").alias("last"),
    )
    _put(merged, path, batch_id)


def revised_bars(spark: SparkSession, path: str) -> DataFrame:
    """The last version of every bar that :func:`revise_bars` has written."""
    return _latest(spark.read.parquet(path), ["series", "ts"]).select("series", "ts", "open", "high", "low", "close", "volume")


def revise_means(rows: DataFrame, batch_id: int, path: str, spans: dict[str, float], order: Order, value: str = "value", zone_seconds: int = 86400) -> None:
    """X4 for ``foreachBatch``: exponential means of ``value`` per series in the order of time, whatever the order of arrival.

    Time is cut into zones of ``zone_seconds``; a carry table has the means at the
    end of each. A micro-batch goes back to the first zone it has rows in, per
    series, takes up the means before it as the value of one earlier row, and
    runs the zoned mean from there over the stored rows. Rows that arrive in
    order read the current zone only; a late row costs the zones after it. Rows
    without a series, time or value are kept, but have no mean.
    """
    spark, tie = rows.sparkSession, order.ties[0]
    zone = F.floor(epoch_seconds("ts") / zone_seconds).alias("zone")
    given = rows.select("series", "ts", tie, F.col(value).cast("double").alias(value), zone)
    _put(given, f"{path}/rows", batch_id)
    placed = F.col("series").isNotNull() & F.col("zone").isNotNull() & F.col(value).isNotNull()
    stored = _stored(spark, f"{path}/rows", given.schema, batch_id + 1).where(placed)
    touched = stored.where(F.col("batch") == batch_id).groupBy("series").agg(F.min("zone").alias("_from"))
    touched = stage(touched, "touched")
    first = touched.agg(F.min("_from")).first()[0]
    if first is None:
        return
    again = join_per_key(stored.where(F.col("zone") >= first), touched, ("series",)).where(F.col("zone") >= F.col("_from"))
    again = again.select("series", "ts", tie, value, "zone", *(F.col(value).alias(f"_x_{m}") for m in spans))

    ends = T.StructType([T.StructField("series", T.StringType()), T.StructField("zone", T.LongType()), *(T.StructField(m, T.DoubleType()) for m in spans)])
    carry = _latest(_stored(spark, f"{path}/carry", ends, batch_id), ["series", "zone"])
    carry = carry.join(touched, "series").where(F.col("zone") < F.col("_from"))
    just_before = wall_clock(F.timestamp_micros(F.col("_from") * (zone_seconds * 1_000_000) - 1))
    head = carry.groupBy("series", "_from").agg(*(F.max_by(m, "zone").alias(f"_x_{m}") for m in spans))
    head = head.select("series", just_before.alias("ts"), *(f"_x_{m}" for m in spans))
    frame = stage(again.unionByName(head, allowMissingColumns=True), "means-input")
    out = ewm(frame, order, {m: (f"_x_{m}", span) for m, span in spans.items()}).where(F.col("zone").isNotNull())
    _put(out.select("series", "ts", tie, value, "zone", *spans), f"{path}/means", batch_id)
    out = spark.read.parquet(f"{path}/means/batch={batch_id}")
    last = total_order("ts", order.ties)
    _put(out.groupBy("series", "zone").agg(*(F.max_by(m, last).alias(m) for m in spans)), f"{path}/carry", batch_id)


def revised_means(spark: SparkSession, path: str) -> DataFrame:
    """The rows of :func:`revise_means` with their means as of the last batch."""
    versions = spark.read.parquet(f"{path}/carry").groupBy("series", "zone").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{path}/means").join(versions, ["series", "zone", "batch"]).drop("zone", "batch")


def run_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Give what the source holds now to ``apply`` as micro-batches with their ids."""
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what the source holds now into Parquet files at ``path``, exactly once."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()

