"""Price bars from ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.scalars import total_order
from tidebar.operators import clean
from tidebar.plans.joins import join_per_key
from tidebar.plans.zones import Order

# Label -> (bar length in seconds, lookback), and the accepted request labels.
TIMEFRAMES = {
    "5m": (300, "1 month"),
    "15m": (900, "1 month"),
    "1h": (3600, "6 months"),
    "1d": (86400, "1 year"),
}
REQUEST_LABELS = {"15min": "15m", "1hr": "1h", "1d": "1d"}


def build_bars(
    ticks: DataFrame,
    interval: str,
    price: str = "price",
    ids: tuple[str, ...] = (),
    volume: Column | None = None,
    slide: str | None = None,
    at: str = "ts",
) -> DataFrame:
    """OHLCV bars of ``interval`` per series; ``slide`` makes them overlap.

    ``ids`` break ties of ``ts``, so open and close are the same on every run.
    ``at`` names the column that assigns a tick to its bar.
    All aggregates have partial forms: a shuffle carries one row per task,
    series and bar, also when one series holds most of the ticks.
    """
    first_last = total_order("ts", ids)
    bucket = F.window(at, interval, slide) if slide else F.window(at, interval)
    return (
        ticks.groupBy("series", bucket.alias("_bar"))
        .agg(
            F.min_by(price, first_last).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, first_last).alias("close"),
            (volume if volume is not None else F.count(F.lit(1))).alias("volume"),
        )
        .select("series", F.col("_bar.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def bar_start(ts: str, seconds: int) -> Column:
    """Start of the bar holding ``ts``, for bars that divide a day."""
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    offset = F.make_dt_interval(secs=F.floor(clock / seconds) * seconds)
    return F.col(ts).cast("date").cast("timestamp_ntz") + offset


def merge_bars(bars: DataFrame, *extra_keys: str) -> DataFrame:
    """Combine bars that share (series, ts, extra keys) and carry their own start in ``_at``."""
    return bars.groupBy("series", *extra_keys, "ts").agg(
        F.min_by("open", "_at").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "_at").alias("close"),
        F.sum("volume").alias("volume"),
    )


def multi_timeframe_bars(base: DataFrame, timeframes: dict = TIMEFRAMES) -> DataFrame:
    """Roll the finest bars up to every timeframe in one pass and one shuffle.

    Each base bar is expanded to one row per timeframe; the partial aggregate
    folds them together again before anything is shuffled. The lookback counts
    back from the latest base bar.
    """
    last = base.agg(F.max("ts")).scalar()
    targets = F.array(
        *[
            F.struct(
                F.lit(label).alias("timeframe"),
                bar_start("ts", seconds).alias("ts"),
                (last - F.expr(f"interval {lookback}")).alias("since"),
            )
            for label, (seconds, lookback) in timeframes.items()
        ]
    )
    rows = base.withColumn("_to", F.explode(targets)).withColumn("_at", F.col("ts"))
    rows = rows.withColumn("timeframe", F.col("_to.timeframe")).withColumn("ts", F.col("_to.ts"))
    return merge_bars(rows.where(F.col("ts") >= F.col("_to.since")), "timeframe")


def select_timeframe(bars: DataFrame, request: str) -> DataFrame:
    """S3: one timeframe by its request label; on a partitioned table only its files are read."""
    if request not in REQUEST_LABELS:
        raise ValueError(f"unknown interval {request!r}; use one of {sorted(REQUEST_LABELS)}")
    return bars.where(F.col("timeframe") == REQUEST_LABELS[request]).drop("timeframe")


def lookback_slice(df: DataFrame, interval: str, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Rows within ``interval`` of the latest row of their keys."""
    latest = df.groupBy(*keys).agg(F.max("ts").alias("_latest"))
    return (
        join_per_key(df, latest, keys)
        .where(F.col("ts") >= F.col("_latest") - F.expr(f"interval {interval}"))
        .drop("_latest")
    )


def load_index_series(bars: DataFrame, order: Order) -> DataFrame:
    """Daily index bars, gaps filled forward, then 0."""
    prices = ["open", "high", "low", "close", "volume"]
    return clean.fill_chain(bars, order, prices, ("ffill", "zero"))


def atm_iv_summary(
    quotes: DataFrame, price: Column, strike_range: float = 0.1, key: str = "underlying"
) -> DataFrame:
    """Mean implied volatility of near-the-money calls and puts per expiry.

    An expiry without any such quote stays: the condition sits inside the
    aggregates, not in a filter. Gaps are filled from the previous expiry, then 0.
    """
    quotes = quotes.withColumn("_price", price)
    near = F.abs(F.col("strike") - F.col("_price")) / F.col("_price") < strike_range
    # a missing kind stands for a quote outside the range
    quotes = quotes.withColumn("_kind", F.when(near, F.col("kind")))
    iv = quotes.groupBy(key, "expiry").agg(
        F.avg(F.when(F.col("_kind") == "call", F.col("iv"))).alias("avg_iv_calls"),
        F.avg(F.when(F.col("_kind") == "put", F.col("iv"))).alias("avg_iv_puts"),
    )
    iv = iv.withColumn("avg_iv", (F.col("avg_iv_calls") + F.col("avg_iv_puts")) / 2)
    expiries = Order(86400 * 30, (key,), "expiry")
    return clean.fill_chain(iv, expiries, ["avg_iv_calls", "avg_iv_puts", "avg_iv"], ("ffill", "zero"))


def latest_price(
    df: DataFrame, price: str = "close", ids: tuple[str, ...] = (), keys: tuple[str, ...] = ("series",)
) -> DataFrame:
    """Price at the latest ``ts`` of the keys."""
    return df.groupBy(*keys).agg(
        F.max_by(price, total_order("ts", ids)).alias(price), F.max("ts").alias("ts")
    )
