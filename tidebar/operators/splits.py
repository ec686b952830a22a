"""Splits and validation without models of their own (V1–V3, V6, V7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidebar.functions.scalars import key_hash
from tidebar.operators import moments
from tidebar.operators.features import HORIZONS_CLOCK, horizon_targets, inline_targets
from tidebar.plans import zones
from tidebar.plans.zones import Order


def chronological_split(df: DataFrame, order: Order, share: float = 0.75, out: str = "split") -> DataFrame:
    """V1: the first ``share`` of each series is ``train``, the rest ``test``."""
    z = zones.enter(df, order)
    train = F.col("_pos") < F.floor(F.col("_n") * share)
    return zones.leave(z.withColumn(out, F.when(train, "train").otherwise("test")))


def random_split(key: Column, test_percent: int = 20) -> Column:
    """V2: ``test`` for a fixed share of the keys; the same rows on every run and engine."""
    return F.when(key_hash(key) % 100 < test_percent, "test").otherwise("train")


def kfold(key: Column, folds: int = 5) -> Column:
    """V3: fold of a key."""
    return (key_hash(key) % folds).cast("int")


Features = dict[str, Callable[[WindowSpec], Column]]


def _past_pairs(w: WindowSpec, features: Features, horizons: dict[str, int], c: str) -> Column:
    """Per horizon what a row adds to the training rows, its features ``steps`` rows ago and its own value, and what it is asked for."""

    def entry(label, steps):
        named = {"horizon": F.lit(label), "steps": F.lit(steps), "_y": F.col(c), "actual": F.lead(c, steps).over(w)}
        named |= {f"_x_{f}": F.lag(f, steps).over(w) for f in features} | {f"_at_{f}": F.col(f) for f in features}
        return F.struct(*(v.alias(n) for n, v in named.items()))

    return F.array(*(entry(label, steps) for label, steps in horizons.items()))


def _with_features(z: DataFrame, order: Order, features: Features, horizons: dict[str, int], c: str) -> DataFrame:
    """One row per (row, horizon) of a zoned frame."""
    w = zones.window(order)
    z = z.withColumns({f: make(w) for f, make in features.items()})
    z = z.withColumn("_asked", _past_pairs(w, features, horizons, c))
    return z.where("_core AND _pos IS NOT NULL").select(*order.keys, order.ts, "_zone", "_core", "_pos", "_n", F.inline("_asked"))


def walk_forward(
    df: DataFrame, order: Order, horizons: dict[str, int] = HORIZONS_CLOCK, every: int = 15, history: int = 48,
    c: str = "close",
) -> DataFrame:
    """V6: forecasts of a trend line from origins every ``every`` rows.

    The line of an origin uses the rows up to it and nothing later. Fitting
    once per origin would read the history again and again; merged moments give
    all lines in one pass. Origins with less than ``history`` rows are skipped.
    """
    z = zones.enter(df, order, after=max(horizons.values()))
    w = zones.window(order)
    ahead = {label: f"_ahead{i}" for i, label in enumerate(horizons)}
    z = z.withColumns({ahead[label]: F.lead(c, steps).over(w) for label, steps in horizons.items()})
    origin = (F.col("_pos") % every == 0) & (F.col("_pos") >= history - 1)
    at_end = {n: F.max(F.when(origin, F.col(v))) for n, v in {"ts": order.ts, "origin": "_pos", **{a: a for a in ahead.values()}}.items()}
    fitted = moments.running_line(z, order, c, F.floor((F.col("_pos") + every - 1) / every), at_end).where("origin IS NOT NULL")
    targets = F.array(*(F.struct(F.lit(label).alias("horizon"), F.lit(steps).alias("steps"), F.col(ahead[label]).alias("actual")) for label, steps in horizons.items()))
    out = inline_targets(fitted.select("series", "ts", "origin", "_b", "_b__x", targets.alias("_targets")), "actual")
    predicted = moments.predicted({"_x": F.col("origin") + F.col("steps")})
    return out.select("series", "ts", "origin", "horizon", "actual", predicted.alias("predicted"))


def walk_forward_features(
    df: DataFrame, order: Order, features: Features, before: int, horizons: dict[str, int] = HORIZONS_CLOCK, every: int = 15,
    history: int = 48, c: str = "close", ridge: float = 0.0,
) -> DataFrame:
    """V6 with features: per horizon a regression of the value ``steps`` rows later on the features of a row.

    An origin's regression knows the rows whose later value lies at or before it;
    nothing after the origin enters its training. ``features`` are columns over a
    window that reach at most ``before`` rows back. Rows without all features train
    nothing; an origin without them, or with fewer known rows than coefficients,
    has a missing forecast.
    """
    reach = max(horizons.values())
    z = _with_features(zones.enter(df, order, before + reach, reach), order, features, horizons, c)
    names = [f"_x_{f}" for f in features]
    origin = (F.col("_pos") % every == 0) & (F.col("_pos") >= history - 1)
    asked = {"ts": order.ts, "origin": "_pos", "actual": "actual", **{f"_at_{f}": f"_at_{f}" for f in features}}
    at_end = {n: F.max(F.when(origin, F.col(v))) for n, v in asked.items()}
    segment = F.floor((F.col("_pos") + every - 1) / every)
    fitted = moments.running_moments(z, order, [*names, "_y"], segment, at_end, ("horizon",))
    fitted = moments.coefficients(fitted.where("actual IS NOT NULL"), names, "_y", ridge)
    predicted = moments.predicted({f"_x_{f}": F.col(f"_at_{f}") for f in features})
    return fitted.select("series", "ts", "origin", "horizon", "actual", predicted.alias("predicted"))


def _covering_days(steps: int, day_rows: int, days: int | None) -> Column:
    """The days whose validation window of ``steps`` rows holds the row, at most ``steps / day_rows`` of them."""
    first = F.greatest(F.lit(1), F.floor((F.col("_pos") - steps) / day_rows) + 1)
    last = F.floor(F.col("_pos") / day_rows)
    last = last if days is None else F.least(F.lit(days - 1), last)
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _validated(rows: DataFrame, days: int | None, horizons: dict[str, int], day_rows: int, least: int) -> DataFrame:
    """(row, horizon) paired with its days; a horizon is skipped where fewer than ``least`` rows are left or the data ends before it."""
    on = F.coalesce(*(F.when(F.col("horizon") == label, _covering_days(steps, day_rows, days)) for label, steps in horizons.items()))
    rows = rows.where(F.col("actual").isNotNull() & (F.col("steps") >= least)).withColumn("day", F.explode(on))
    return rows.where(F.col("day") * day_rows + F.col("steps") < F.col("_n"))


def expanding_daily(
    df: DataFrame, order: Order, horizons: dict[str, int] = HORIZONS_CLOCK, days: int | None = None, day_rows: int = 96,
    least: int = 48, c: str = "close",
) -> DataFrame:
    """V7: per day and horizon, train on the rows before the day, validate on the next ``steps`` rows.

    Each validation row is paired with the days whose window covers it, so no
    range join is needed. ``days`` limits the days to the first ones; all by default.
    """
    z = zones.enter(df, order, after=max(horizons.values()))
    w = zones.window(order)
    day_end = {"_end": F.max(F.when((F.col("_pos") + 1) % day_rows == 0, F.col("_pos")))}
    lines = moments.running_line(z, order, c, F.floor(F.col("_pos") / day_rows), day_end).where("_end IS NOT NULL")
    lines = lines.select("series", ((F.col("_end") + 1) / day_rows).cast("long").alias("day"), "_b", "_b__x")
    if days is not None:
        lines = lines.where(F.col("day") < days)
    z = z.withColumn("_targets", horizon_targets(w, horizons, c, "actual")).where("_core AND _pos IS NOT NULL")
    rows = _validated(z.select("series", "_pos", "_n", F.inline("_targets")), days, horizons, day_rows, least)
    predicted = moments.predicted({"_x": F.col("_pos") + F.col("steps")})
    return rows.join(lines, ["series", "day"]).select("series", "day", "horizon", F.col("_pos").alias("row"), "actual", predicted.alias("predicted"))


def expanding_daily_features(
    df: DataFrame, order: Order, features: Features, before: int, horizons: dict[str, int] = HORIZONS_CLOCK, days: int | None = None,
    day_rows: int = 96, least: int = 48, c: str = "close", ridge: float = 0.0,
) -> DataFrame:
    """V7 with features: per day and horizon a regression on the features of the rows before the day.

    Trained on the rows whose value ``steps`` later lies before the day, see
    :func:`walk_forward_features`; validated like :func:`expanding_daily`.
    """
    reach = max(horizons.values())
    z = _with_features(zones.enter(df, order, before + reach, reach), order, features, horizons, c)
    names = [f"_x_{f}" for f in features]
    day_end = {"_end": F.max(F.when((F.col("_pos") + 1) % day_rows == 0, F.col("_pos")))}
    fitted = moments.running_moments(z, order, [*names, "_y"], F.floor(F.col("_pos") / day_rows), day_end, ("horizon",))
    fitted = moments.coefficients(fitted.where("_end IS NOT NULL"), names, "_y", ridge)
    fitted = fitted.select("series", "horizon", ((F.col("_end") + 1) / day_rows).cast("long").alias("day"), "_b", *(f"_b_{n}" for n in names))
    if days is not None:
        fitted = fitted.where(F.col("day") < days)
    rows = _validated(z, days, horizons, day_rows, least).join(fitted, ["series", "horizon", "day"])
    predicted = moments.predicted({f"_x_{f}": F.col(f"_at_{f}") for f in features})
    return rows.select("series", "day", "horizon", F.col("_pos").alias("row"), "actual", predicted.alias("predicted"))
