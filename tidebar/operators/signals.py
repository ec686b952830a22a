"""Option-strategy signals from indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidebar.operators import indicators
from tidebar.plans import zones
from tidebar.plans.zones import Order

CALM_ROWS = 10  # fixed default
# Fixed strategy names.
STRATEGIES = (
    "debit_spread_call",
    "debit_spread_put",
    "credit_spread_put",
    "credit_spread_call",
    "iron_condor",
    "straddle",
    "strangle",
    "butterfly",
)


def flag(condition: Column) -> Column:
    """1 where true, 0 where false or missing."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def calm(w: WindowSpec) -> Column:
    """ATR below its mean of the last rows; false until the frame is full."""
    return F.col("atr") < indicators.full(F.avg, "atr", w, CALM_ROWS)


def signal_columns(is_calm: Column, part: float = indicators.PART) -> dict[str, Column]:
    """G1–G8 on indicator columns.

    Means differ when they do so by more than ``part`` of the price: on the first
    row of a series they are equal, and noise in the last digits must not fire a
    signal, whatever the price level.
    """
    c = F.col
    least = part * F.abs("close")
    trend, swing = c("ema9") - c("ema21"), c("macd") - c("macd_signal")
    up, down = trend > least, trend < -least
    width = c("upper_band") - c("lower_band")
    wide, neutral = width > 2 * c("atr"), (c("rsi") > 40) & (c("rsi") < 60)
    return {
        "debit_spread_call": flag(up & (swing > least) & (c("rsi") < 70)),
        "debit_spread_put": flag(down & (swing < -least) & (c("rsi") > 30)),
        "credit_spread_put": flag((c("close") > c("lower_band")) & (c("rsi") > 40) & up & is_calm),
        "credit_spread_call": flag((c("close") < c("upper_band")) & (c("rsi") < 60) & down & is_calm),
        "iron_condor": flag((width < 2 * c("atr")) & is_calm),
        "straddle": flag(wide & neutral),
        "strangle": flag(wide & neutral),
        "butterfly": flag((width < c("atr")) & neutral),
    }


def trade_signals(frame: DataFrame, order: Order) -> DataFrame:
    """G1–G8 on a finished indicator frame."""
    z = zones.enter(frame, order, before=CALM_ROWS)
    z = z.withColumn("_calm", calm(zones.window(order)))
    z = z.withColumns(signal_columns(F.col("_calm"))).drop("_calm")
    return zones.leave(z).select("series", "ts", *STRATEGIES)


def signals_from_bars(bars: DataFrame, order: Order, keep: tuple[str, ...] = ()) -> DataFrame:
    """I20 and G1–G8 from one shuffle of the bars."""
    z = zones.enter(bars, order, before=indicators.CONTEXT + CALM_ROWS)
    z = indicators.zoned_indicators(z, order)
    z = z.withColumn("_calm", calm(zones.window(order)))
    z = z.withColumns(signal_columns(F.col("_calm"))).drop("_calm")
    return zones.leave(z).select("series", "ts", *keep, *STRATEGIES)


def band_signals_from_bars(bars: DataFrame, order: Order) -> DataFrame:
    """G5–G8 only: no exponential mean, so no carry between zones."""
    z = zones.enter(bars, order, before=indicators.CONTEXT + CALM_ROWS)
    w = zones.window(order)
    i = indicators
    z = z.withColumns(i.pick(i.price_changes(w), "prev_close", "_d"))
    z = z.withColumns(i.pick(i.movements(), "tr", "_up", "_down"))
    z = z.withColumns(i.pick(i.frames(w), "_up_n", "_down_n", "_tr_n", "sma20", "_sd"))
    z = z.withColumns(i.pick(i.values(), "rsi", "atr", "upper_band", "lower_band"))
    z = z.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("upper_band", "lower_band", "atr")})
    z = z.withColumn("_calm", calm(w))
    z = z.withColumns({k: F.lit(0.0) for k in ("ema9", "ema21", "macd", "macd_signal")})
    chosen = {k: v for k, v in signal_columns(F.col("_calm")).items() if k in STRATEGIES[4:]}
    return zones.leave(z.withColumns(chosen)).select("series", "ts", *STRATEGIES[4:])


def long_signals(signals: DataFrame, strategies=STRATEGIES, keys: tuple[str, ...] = ("series", "ts")) -> DataFrame:
    """One row per (row, strategy)."""
    return signals.unpivot(list(keys), list(strategies), "strategy", "fired")


def signal_counts(signals: DataFrame, strategies=STRATEGIES) -> DataFrame:
    """Firings and rows per series and strategy; summed wide, then unpivoted."""
    wide = signals.groupBy("series").agg(
        *[F.sum(s).alias(s) for s in strategies], F.count(F.lit(1)).alias("bars")
    )
    return wide.unpivot(["series", "bars"], list(strategies), "strategy", "fired")
