"""Calendar grids, alignment and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.scalars import col, minute_of_day, weekday
from tidebar.operators import indicators
from tidebar.operators.ewm import ewm_carry
from tidebar.operators.features import FEATURE_CONTEXT, lag_features, moving_averages
from tidebar.plans import zones
from tidebar.plans.zones import Order
from tidebar.sources.bars import lookback_slice

# Fixed market hours, minutes of the day; both ends belong to the day.
OPEN_MINUTE, CLOSE_MINUTE = 570, 960
# Finest first: the order in which resolutions are concatenated.
RESOLUTIONS = ("15m", "1h", "1d")


def calendar_grid(
    bounds: DataFrame, step: str = "15 minutes", keys: tuple[str, ...] = ("series",),
    weekdays_only: bool = False, market_hours: bool = False,
) -> DataFrame:
    """Timestamps from ``first`` to ``last`` per keys, both included.

    Days are laid out first and slots second, so the long expansion starts from
    many rows, and days that cannot hold a wanted slot are never expanded. The
    optional filters need slots that start at midnight plus a multiple of
    ``step``, as the bars do.
    """
    every = F.expr(f"interval {step}")
    day = F.expr("interval 1 day")
    days = bounds.withColumn("_day", F.explode(F.sequence("first", "last", day)))
    if weekdays_only:
        # a 24-hour stretch that begins on Saturday at midnight or later ends on Sunday or Monday
        days = days.where((weekday("_day") < 5) | (weekday(F.col("_day") + day) < 5))
    days = days.repartition(*keys, "_day")
    until = F.least(F.col("last"), F.col("_day") + day - every)
    grid = days.select(*keys, F.explode(F.sequence(F.col("_day"), until, every)).alias("ts"))
    if weekdays_only:
        grid = grid.where(weekday_filter("ts"))
    if market_hours:
        grid = grid.where(between_time("ts"))
    return grid


def weekday_filter(ts: str | Column) -> Column:
    """R2: Monday to Friday."""
    return weekday(ts) < 5


def between_time(ts: str | Column, start: int = OPEN_MINUTE, end: int = CLOSE_MINUTE) -> Column:
    """Time of day within [start, end] minutes, to the second."""
    t = col(ts)
    seconds = minute_of_day(t) * 60 + F.second(t)
    return seconds.between(start * 60, end * 60)


def series_bounds(df: DataFrame, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))


def reindex(grid: DataFrame, df: DataFrame, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Rows of the grid, with the values of ``df`` where it has the timestamp."""
    return grid.join(df, [*keys, "ts"], "left")


def upsample_asfreq(df: DataFrame, step: str = "15 minutes", keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """A coarse series on a finer grid, missing in between."""
    return reindex(calendar_grid(series_bounds(df, keys), step, keys), df, keys)


def interpolate_zoned(z: DataFrame, order: Order, columns: dict[str, str]) -> DataFrame:
    """R5 on a zoned frame: ``out -> source``, linear by row position.

    Leading values stay missing, trailing ones repeat the last value.
    """
    carry = zones.Carry(z, order)
    for out, c in columns.items():
        point = F.when(F.col(c).isNotNull(), F.struct(F.col("_pos").alias("i"), F.col(c).alias("v")))
        carry.fill_forward(f"_p_{out}", point)
        carry.fill_backward(f"_q_{out}", point)
    z = carry.apply()
    values = {}
    for out, c in columns.items():
        p, q = F.col(f"_p_{out}"), F.col(f"_q_{out}")
        share = (F.col("_pos") - p["i"]) / F.nullif(q["i"] - p["i"], F.lit(0))
        values[out] = F.coalesce(F.col(c), F.when(q.isNull(), p["v"]).otherwise(p["v"] + (q["v"] - p["v"]) * share))
    z = z.withColumns(values)
    return z.drop(*[f"_{a}_{o}" for o in columns for a in "pq"])


def interpolate_linear(df: DataFrame, order: Order, columns: list[str]) -> DataFrame:
    """R5."""
    z = interpolate_zoned(zones.enter(df, order), order, {c: c for c in columns})
    return zones.leave(z)


def union_resolutions(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of all resolutions, named in ``resolution``; absent columns become missing."""
    out = None
    for label, part in parts.items():
        part = part.withColumn("resolution", F.lit(label))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def dedup_precedence(
    df: DataFrame, precedence: str = "finest", keys: tuple[str, ...] = ("series", "ts")
) -> DataFrame:
    """One row per keys. ``finest`` keeps the finest resolution, ``coarse`` the coarsest."""
    if precedence not in ("finest", "coarse"):
        raise ValueError("precedence is 'finest' or 'coarse'")
    order = RESOLUTIONS if precedence == "coarse" else RESOLUTIONS[::-1]
    labels = F.array(*[F.lit(label) for label in order])
    rest = [c for c in df.columns if c not in (*keys, "resolution")]
    # fixed-width ranks and values keep this a hash aggregate with a partial step
    best = df.withColumn("_rank", F.array_position(labels, F.col("resolution"))).groupBy(*keys).agg(
        *[F.max_by(c, "_rank").alias(c) for c in rest], F.max("_rank").alias("_rank")
    )
    return best.withColumn("resolution", F.element_at(labels, F.col("_rank").cast("int"))).drop("_rank")


def positional_align(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("series", "ts")) -> DataFrame:
    """Pair two row sets by key, never by position."""
    return left.join(right, list(keys), "inner")


def year_of_15min(
    bars_15m: DataFrame, bars_1h: DataFrame, bars_1d: DataFrame, order: Order,
    days: int = 365, precedence: str = "finest", stage=None,
) -> DataFrame:
    """A trailing year of 15-minute market-hours rows with features.

    Coarse bars are put on the 15-minute grid and interpolated, all resolutions
    are united with one row per timestamp, cut to the last ``days``, aligned on
    the market calendar, interpolated again and given their features. Volume
    comes from 15-minute bars only and is 0 elsewhere. ``stage`` writes the aligned table,
    which the steps after it read several times.
    """
    prices = ["open", "high", "low", "close"]
    finer = []
    for coarse in (bars_1h, bars_1d):
        up = upsample_asfreq(coarse.select("series", "ts", *prices))
        finer.append(interpolate_linear(stage(up, "grid") if stage else up, order, prices))
    parts = dict(zip(RESOLUTIONS, [bars_15m, *finer]))
    rows = dedup_precedence(union_resolutions(parts), precedence).drop("resolution")
    if stage:
        rows = stage(rows, "united")
    rows = lookback_slice(rows, f"{days} days")
    grid = calendar_grid(series_bounds(rows), weekdays_only=True, market_hours=True)
    aligned = reindex(grid, rows)
    if stage:
        aligned = stage(aligned, "aligned")
    aligned = interpolate_linear(aligned, order, prices)
    aligned = aligned.withColumn("volume", F.coalesce(F.col("volume").cast("double"), F.lit(0.0)))
    if stage:
        aligned = stage(aligned, "year")
    return year_features(aligned, order)


def year_features(df: DataFrame, order: Order) -> DataFrame:
    """Features of R9: I21, F1–F4, I22–I24 on close."""
    df = df.withColumn("close", F.coalesce("close", F.lit(0.0)))
    z = zones.enter(df, order, before=FEATURE_CONTEXT)
    w = zones.window(order)
    z = z.withColumn("impulse_color", indicators.simple_impulse("close", w))
    z = indicators.bollinger(indicators.with_rsi_short(z, w), w).drop("sma20")
    new = {**lag_features("close", w), **moving_averages("close", w)}
    z = z.withColumns(new)
    carry = ewm_carry(z, order, {"_fast": ("close", 12), "_slow": ("close", 26)})
    filled = [*new, "rsi", "upper_band", "lower_band"]
    for c in filled:
        carry.fill_backward(c, c)
    z = carry.apply().withColumns(
        {
            "macd_histogram": F.col("_fast") - F.col("_slow"),
            "day_of_week": weekday("ts"),
            "hour_of_day": F.hour("ts"),
            **{c: F.coalesce(F.col(c), F.lit(0.0)) for c in filled},
        }
    )
    return zones.leave(z.drop("_fast", "_slow"))
