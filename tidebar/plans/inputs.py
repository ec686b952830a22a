"""The engine's input tables, derived from the given star-schema and event tables.

Ticks and quotes are lazy views of the given files. Bars are built once per
application and stored, as ingest does; queries read the stored bars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.functions.scalars import key_hash
from tidebar.plans.zones import Order
from tidebar.session import stage_once
from tidebar.sources.bars import build_bars

H = Order(3600)
Q = Order(900)
D = Order(86400)
LINE_IDS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ticks(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    """Events as ticks: one series per event type, or one series of all."""
    series = F.lit("ALL") if whole else F.col("event_type")
    return table(spark, sf, "events").select(
        series.alias("series"), "ts", F.col("value").alias("price"), "event_id"
    )


def order_ticks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("series"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("price"),
        "o_orderkey",
    )


def line_ticks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("series"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        "l_quantity",
        *LINE_IDS,
    )


def _stored(spark, sf, name, build) -> DataFrame:
    return stage_once(spark, f"{sf}/{name}", build)


def bars_5m_all(spark, sf) -> DataFrame:
    return _stored(spark, sf, "bars_5m_all", lambda: build_bars(ticks(spark, sf, True), "5 minutes", ids=("event_id",)))


def bars_h(spark, sf) -> DataFrame:
    return _stored(spark, sf, "bars_h", lambda: build_bars(ticks(spark, sf), "1 hour", ids=("event_id",)))


def bars_h_all(spark, sf) -> DataFrame:
    return _stored(spark, sf, "bars_h_all", lambda: build_bars(ticks(spark, sf, True), "1 hour", ids=("event_id",)))


def bars_15m_all(spark, sf) -> DataFrame:
    return _stored(
        spark, sf, "bars_15m_all", lambda: build_bars(ticks(spark, sf, True), "15 minutes", ids=("event_id",))
    )


def bars_d_all(spark, sf) -> DataFrame:
    return _stored(spark, sf, "bars_d_all", lambda: build_bars(ticks(spark, sf, True), "1 day", ids=("event_id",)))


def bars_d(spark, sf) -> DataFrame:
    return _stored(spark, sf, "bars_d", lambda: build_bars(order_ticks(spark, sf), "1 day", ids=("o_orderkey",)))


def bars_d_flag(spark, sf) -> DataFrame:
    return _stored(
        spark,
        sf,
        "bars_d_flag",
        lambda: build_bars(line_ticks(spark, sf), "1 day", ids=LINE_IDS, volume=F.sum("l_quantity")),
    )


def quotes(spark, sf) -> DataFrame:
    """Option quotes: calls and puts with strike and implied volatility per monthly expiry."""
    kind = F.when(F.col("l_linenumber") % 2 == 1, "call").otherwise("put")
    return table(spark, sf, "lineitem").select(
        F.lit("ALL").alias("underlying"),
        F.trunc(F.col("l_shipdate").cast("date"), "month").cast("timestamp_ntz").alias("expiry"),
        kind.alias("kind"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("strike"),
        F.col("l_discount").alias("iv"),
    )


def macro(spark, sf) -> DataFrame:
    """One low-frequency series: order value per month."""
    month = F.trunc(F.col("o_orderdate").cast("date"), "month").cast("timestamp_ntz")
    return _stored(
        spark,
        sf,
        "macro",
        lambda: table(spark, sf, "orders")
        .groupBy(F.lit("orders").alias("name"), month.alias("ts"))
        .agg(F.round(F.sum("o_totalprice"), 2).alias("value")),
    )


def articles(spark, sf) -> DataFrame:
    """Documents as news: the first line as title and an hour of publication."""
    published = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(hours=F.col("doc_id").cast("int"))
    return table(spark, sf, "documents").select(
        "doc_id", "lang", "source", "text", F.substring_index("text", "\n", 1).alias("title"), published.alias("published_at")
    )


def payloads(spark, sf) -> DataFrame:
    """One JSON payload per document; each seventh has no article list."""
    published = F.when(F.col("doc_id") % 11 == 0, F.lit("unknown")).otherwise(
        F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    )
    article = F.struct(
        F.struct(F.col("source").alias("id"), F.upper("source").alias("name")).alias("source"),
        F.col("title"),
        published.alias("publishedAt"),
    )
    body = F.when(
        F.col("doc_id") % 7 != 0, F.to_json(F.struct(F.lit("ok").alias("status"), F.array(article).alias("articles")))
    ).otherwise(F.to_json(F.struct(F.lit("ok").alias("status"))))
    return articles(spark, sf).select("doc_id", body.alias("payload"))


def lexicon(spark, sf) -> DataFrame:
    """Word polarities: each distinct word, scored by its hash."""
    from tidebar.sources.macro_news import tokens

    def build():
        words = articles(spark, sf).select(F.explode(tokens("text")).alias("token")).distinct()
        return words.select("token", ((key_hash("token") % 201 - 100) / 100).alias("polarity"))

    return _stored(spark, sf, "lexicon", build)


def gappy(df: DataFrame, percent: int = 40) -> DataFrame:
    """Bars with some closes missing, chosen by key: input of the fills."""
    from tidebar.functions.scalars import series_key

    miss = key_hash(series_key("series", "ts")) % 100 < percent
    return df.withColumn("close", F.when(~miss, F.col("close")))
