"""Features, targets and sequences (F1–F16)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidebar.functions.scalars import col, weekday
from tidebar.operators.clean import (
    SEQUENCE_FEATURES,
    encode_category,
    fill_chain,
    numeric_columns,
)
from tidebar.plans import zones
from tidebar.plans.joins import join_per_key
from tidebar.plans.zones import Order

# Fixed default lags, averages and horizons (label -> row steps).
LAGS = (1, 2, 3)
AVERAGES = (5, 10, 15)
SEQUENCE_ROWS = 48
HORIZON_ROWS = (12, 24, 36, 48, 72, 96)
HORIZONS_CLOCK = {"24h": 96, "48h": 192, "72h": 288, "96h": 384, "168h": 672}
HORIZONS_MARKET = {"24h": 26, "48h": 52, "72h": 78, "96h": 104, "168h": 182}
FEATURE_CONTEXT = 32


def lag_features(c: str, w: WindowSpec, lags=LAGS) -> dict[str, Column]:
    """F1."""
    return {f"{c}_lag_{k}": F.lag(c, k).over(w) for k in lags}


def moving_averages(c: str, w: WindowSpec, lengths=AVERAGES) -> dict[str, Column]:
    """full frames only."""
    out = {}
    for n in lengths:
        frame = w.rowsBetween(-(n - 1), 0)
        out[f"{c}_ma_{n}"] = F.when(F.count(c).over(frame) >= n, F.avg(c).over(frame))
    return out


def lags_and_averages(df: DataFrame, order: Order, c: str = "close") -> DataFrame:
    """F1 and F2 on one shuffle."""
    z = zones.enter(df, order, before=max(*LAGS, *AVERAGES))
    w = zones.window(order)
    return zones.leave(z.withColumns({**lag_features(c, w), **moving_averages(c, w)}))


def backfilled_zoned(z: DataFrame, order: Order, c: str = "close") -> DataFrame:
    w = zones.window(order)
    new = {**lag_features(c, w), **moving_averages(c, w)}
    z = z.withColumns(new)
    names = list(new)
    z = zones.fill_backward(z, order, {n: n for n in names})
    return z.withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) for n in names})


def backfilled_features(df: DataFrame, order: Order, c: str = "close") -> DataFrame:
    """F1 and F2 with the leading gap filled back."""
    z = zones.enter(df, order, before=max(*LAGS, *AVERAGES))
    return zones.leave(backfilled_zoned(z, order, c))


def calendar_features(ts: str = "ts") -> dict[str, Column]:
    """Monday is 0."""
    return {"day_of_week": weekday(ts), "hour": F.hour(ts), "minute": F.minute(ts)}


def cyclic_time(ts: str = "ts") -> dict[str, Column]:
    """F5."""
    hour, minute = 2 * math.pi * F.hour(ts) / 24, 2 * math.pi * F.minute(ts) / 60
    return {
        "hour_sin": F.sin(hour),
        "hour_cos": F.cos(hour),
        "minute_sin": F.sin(minute),
        "minute_cos": F.cos(minute),
    }


def scaler(df: DataFrame, columns, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Smallest and largest value per column, one row per keys."""
    return df.groupBy(*keys).agg(
        *[F.min(c).alias(f"_min_{c}") for c in columns], *[F.max(c).alias(f"_max_{c}") for c in columns]
    )


def minmax_expr(c: str) -> Column:
    low, high = F.col(f"_min_{c}"), F.col(f"_max_{c}")
    return F.when(F.col(c).isNotNull() & (high == low), F.lit(0.0)).otherwise((F.col(c) - low) / (high - low))


def minmax_scale(
    df: DataFrame, columns, fitted: DataFrame | None = None, keys: tuple[str, ...] = ("series",)
) -> DataFrame:
    """``<column>_scaled`` in [0, 1] on the fitted rows; 0 for a constant column.

    ``fitted`` is the scaler of the training rows; without it the scaler is
    fitted on ``df``.
    """
    fitted = scaler(df, columns, keys) if fitted is None else fitted
    out = join_per_key(df, fitted, keys)
    out = out.withColumns({f"{c}_scaled": minmax_expr(c) for c in columns})
    return out.drop(*[f"_{m}_{c}" for c in columns for m in ("min", "max")])


def inverse_scale(
    df: DataFrame, value: str, column: str, fitted: DataFrame, out: str, keys: tuple[str, ...] = ("series",)
) -> DataFrame:
    """a scaled value back in units of ``column``, with the training scaler."""
    low, high = F.col(f"_min_{column}"), F.col(f"_max_{column}")
    fitted = fitted.select(*keys, f"_min_{column}", f"_max_{column}")
    df = join_per_key(df, fitted, keys).withColumn(out, F.col(value) * (high - low) + low)
    return df.drop(f"_min_{column}", f"_max_{column}")


def forward_target(df: DataFrame, order: Order, steps: int, c: str = "close", out: str = "target") -> DataFrame:
    """F8: value ``steps`` rows ahead; the last rows, which have none, are dropped."""
    df = zones.over(df, order, after=steps, **{out: lambda w: F.lead(c, steps).over(w)})
    return df.where(F.col(out).isNotNull())


def multi_horizon_targets(df: DataFrame, order: Order, horizons, c: str = "close") -> DataFrame:
    """one row per (row, horizon) with its target, all horizons from one shuffle."""
    if not isinstance(horizons, dict):
        horizons = {str(h): h for h in horizons}
    z = zones.enter(df, order, after=max(horizons.values()))
    z = z.withColumn("_targets", horizon_targets(zones.window(order), horizons, c))
    return inline_targets(zones.leave(z))


def horizon_targets(w: WindowSpec, horizons: dict[str, int], c: str = "close", out: str = "target") -> Column:
    """Array of (horizon, steps, value ``steps`` rows ahead)."""
    return F.array(
        *[
            F.struct(F.lit(label).alias("horizon"), F.lit(steps).alias("steps"), F.lead(c, steps).over(w).alias(out))
            for label, steps in horizons.items()
        ]
    )


def inline_targets(df: DataFrame, out: str = "target") -> DataFrame:
    """One row per entry of ``_targets`` that has a value."""
    df = df.select(*[x for x in df.columns if x != "_targets"], F.inline("_targets"))
    return df.where(F.col(out).isNotNull())


def horizon_table(spark, path: str, section: str = "intervals") -> DataFrame:
    """(label, steps) rows of one section of a JSON configuration file."""
    config = spark.read.option("multiLine", True).json(path)
    labels = config.schema[section].dataType.names
    pairs = F.array(
        *[
            F.struct(F.lit(n).alias("label"), F.col(f"`{section}`.`{n}`").cast("int").alias("steps"))
            for n in labels
        ]
    )
    return config.select(F.inline(pairs))


def sequences(
    df: DataFrame, order: Order, features=SEQUENCE_FEATURES, length: int = SEQUENCE_ROWS, steps: int = 26,
    target: str = "close", fitted: DataFrame | None = None,
) -> DataFrame:
    """the last ``length`` rows of scaled features and the scaled target ``steps`` ahead.

    One row per end position; n - length - steps + 1 rows per series. The array
    holds ``length`` structs of bounded size, built inside a zone.
    """
    df = minmax_scale(df, list(dict.fromkeys([*features, target])), fitted)
    z = zones.enter(df, order, before=length - 1, after=steps)
    w = zones.window(order)
    step = F.struct(*[F.col(f"{c}_scaled").alias(c) for c in features])
    z = z.withColumns(
        {
            "sequence": F.collect_list(step).over(w.rowsBetween(-(length - 1), 0)),
            "target": F.lead(f"{target}_scaled", steps).over(w),
        }
    )
    z = z.where((F.col("_pos") >= length - 1) & F.col("target").isNotNull())
    return zones.leave(z).select("series", "ts", "sequence", "target")


def sequences_next(df: DataFrame, order: Order, features=SEQUENCE_FEATURES, length: int = SEQUENCE_ROWS) -> DataFrame:
    """the target is the next row; a series shorter than ``length`` is an error."""
    size = F.count(F.lit(1))
    short = df.groupBy("series").agg(
        F.when(size < length, F.raise_error(F.lit(f"a series has fewer than {length} rows")))
        .otherwise(size)
        .alias("_rows")
    )
    rows = join_per_key(df, short, ("series",)).where(F.col("_rows") > 0).drop("_rows")
    return sequences(rows, order, features, length, 1)


def sequences_alternating(
    df: DataFrame, order: Order, c: str = "close_scaled", longest: int = 14, shift: int = 10
) -> DataFrame:
    """sequences of 13 or 14 rows from each start, padded with 0 to ``longest``.

    Start 0 and odd starts take one row less than ``longest``, even starts from
    2 take ``longest``. The target is the value ``shift`` rows after the last row
    of the sequence. n - shift - longest sequences per series.
    """
    z = zones.enter(df, order, after=longest + shift)
    w = zones.window(order)
    short = (F.col("_pos") == 0) | (F.col("_pos") % 2 == 1)
    size = F.when(short, longest - 1).otherwise(longest)
    ahead = F.collect_list(c).over(w.rowsBetween(0, longest - 1))
    z = z.withColumns(
        {
            "seq_len": size,
            "_ahead": ahead,
            "target": F.when(short, F.lead(c, longest - 2 + shift).over(w)).otherwise(
                F.lead(c, longest - 1 + shift).over(w)
            ),
        }
    )
    z = z.where(F.col("_pos") < F.col("_n") - shift - longest)
    padded = F.concat(
        F.slice("_ahead", F.lit(1), F.col("seq_len")),
        F.array_repeat(F.lit(0.0), F.lit(longest) - F.col("seq_len")),
    )
    z = z.withColumn("sequence", padded).withColumn("start", F.col("_pos"))
    return zones.leave(z).select("series", "ts", "start", "seq_len", "sequence", "target")


def last_timestep(sequence: str = "sequence") -> Column:
    """the last row of a sequence."""
    return F.element_at(col(sequence), -1)


def binary_trend_label(fast: str = "ema9", slow: str = "ema21") -> Column:
    """F15."""
    return (F.col(fast) > F.col(slow)).cast("int")


def combined_training_frame(frames: dict[str, DataFrame], orders: dict[str, Order], target: str = "close") -> DataFrame:
    """F16: indicator frames of all timeframes as one numeric feature table.

    Colour codes, calendar and cyclic time are added; gaps are filled forward
    and back inside each series and timeframe, never across them.
    """
    out = None
    for timeframe, frame in frames.items():
        if "impulse_color" in frame.columns:
            frame = frame.withColumn("impulse_color", encode_category("impulse_color"))
        frame = frame.withColumns({**calendar_features(), **cyclic_time()})
        numbers = numeric_columns(frame)
        gaps = [c for c in numbers if frame.schema[c].nullable]
        if gaps:
            frame = fill_chain(frame, orders[timeframe], gaps, ("ffill", "bfill"))
        frame = frame.select(F.lit(timeframe).alias("timeframe"), "series", "ts", *numbers)
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out.withColumnRenamed(target, "target")


def flat_vector(sequence: str, features=SEQUENCE_FEATURES) -> Column:
    """Sequence of structs as one flat array, row after row."""
    rows = F.transform(F.col(sequence), lambda s: F.array(*[s[f] for f in features]))
    return F.flatten(rows)
