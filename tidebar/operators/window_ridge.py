"""Ridge regression on whole windows of rows (M8 on F10) without building the windows.

A window of 48 rows and five features has 240 inputs, each a value that 47
neighbouring windows share. The products their normal equations need depend only
on how far two rows are apart, but for the rows at both ends of the training
range. So a zone sums the products of its rows with each of the 47 rows before
them, Spark adds up the zones, and a few rows per series correct the ends.
A prediction is a sum over lags, computed zone by zone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.plans import zones
from tidebar.plans.zones import Order
from tidebar.session import stage


def _training_end(length: int, steps: int, share: float) -> Column:
    """Windows may end before this row, so that their target lies in the first ``share`` of the series."""
    return F.greatest(F.lit(length - 1), F.floor(F.col("_n") * share) - steps).cast("long")


def _arrays(rows: pa.Table, features: tuple[str, ...]) -> tuple[pa.Table, np.ndarray]:
    rows = rows.sort_by("_pos")
    values = np.column_stack([rows.column(f).to_numpy().astype(float) for f in features]) if rows.num_rows else np.zeros((0, len(features)))
    if np.isnan(values).any():
        raise ValueError(f"a row misses one of {features}: fill them first")
    return rows, values


def _enter(df: DataFrame, order: Order, features: tuple[str, ...], target: str, length: int, steps: int, share: float) -> DataFrame:
    z = zones.enter(df, order, length - 1, steps).where("_pos IS NOT NULL")
    z = z.withColumn("_y", F.lead(target, steps).over(zones.window(order))).withColumn("_end", _training_end(length, steps, share))
    return z.select(*order.keys, order.ts, "_zone", "_core", "_pos", "_n", "_end", "_y", *features)


def _sums(z: DataFrame, order: Order, features: tuple[str, ...], length: int) -> DataFrame:
    """(keys, place, v): lagged products, products with the target, sums, of all training rows; few numbers per zone."""
    kinds = ", ".join(f"`{k}` {z.schema[k].dataType.simpleString()}" for k in order.keys)

    def of_zone(rows: pa.Table) -> pa.Table:
        rows, x = _arrays(rows, features)
        pos, end = rows.column("_pos").to_numpy(), rows.column("_end")[0].as_py()
        used = np.flatnonzero(rows.column("_core").to_numpy(zero_copy_only=False) & (pos >= length - 1) & (pos < end))
        if not len(used):
            return pa.table({k: rows.column(k).slice(0, 0) for k in order.keys} | {"flat": pa.array([], pa.list_(pa.float64()))})
        a, b = used[0], used[-1] + 1
        y = rows.column("_y").to_numpy()[a:b].astype(float)
        products = [x[a:b].T @ x[a - d : b - d] for d in range(length)]
        with_target = [x[a - d : b - d].T @ y for d in range(length)]
        flat = np.concatenate([np.ravel(products), np.ravel(with_target), x[a:b].sum(0), [y.sum(), len(y)]])
        return pa.table({k: rows.column(k).slice(0, 1) for k in order.keys} | {"flat": pa.array([flat.tolist()], pa.list_(pa.float64()))})

    flat = z.groupBy(*order.keys, "_zone").applyInArrow(of_zone, f"{kinds}, flat array<double>")
    return flat.select(*order.keys, F.posexplode("flat").alias("place", "v")).groupBy(*order.keys, "place").agg(F.sum("v").alias("v"))


def _solved(flat: np.ndarray, head: np.ndarray, tail: np.ndarray, length: int, size: int, alpha: float) -> tuple[np.ndarray, float]:
    """Weights (length, size) and intercept. ``head``: the ``length - 1`` rows before the first training row; ``tail``: the last as many."""
    cut = np.cumsum([length * size * size, length * size, size])
    products, with_target, total = (v.reshape(*s) for v, s in zip(np.split(flat, cut)[:3], ((length, size, size), (length, size), (size,))))
    (y_sum, n), reach = flat[cut[-1] :], length - 1
    gram, mean = np.zeros((length, size, length, size)), np.zeros((length, size))
    for d in range(length):
        now = products[d].copy()
        for lag in range(length - d):
            if lag:  # one row more at the start, one less at the end
                now += np.outer(head[reach - lag], head[reach - lag - d]) - np.outer(tail[reach - lag], tail[reach - lag - d])
            gram[lag, :, lag + d] = now
            gram[lag + d, :, lag] = now.T
    for lag in range(length):
        mean[lag] = (total + head[reach - lag :].sum(0) - tail[reach - lag :].sum(0)) / n
    m = mean.ravel()
    centred = gram.reshape(length * size, -1) - n * np.outer(m, m) + alpha * np.eye(length * size)
    w = np.linalg.lstsq(centred, with_target.ravel() - m * y_sum, rcond=1e-12)[0]
    return w.reshape(length, size), float(y_sum / n - w @ m)


def window_ridge(
    df: DataFrame, order: Order, features: tuple[str, ...], length: int = 48, steps: int = 26, target: str = "close",
    share: float = 0.75, alpha: float = 1.0,
) -> DataFrame:
    """Per series, predictions of ``target`` ``steps`` rows after each window of ``length`` rows: (keys, ts, row, split, actual, predicted).

    Trained on the windows whose target lies in the first ``share`` of the series
    (``train``); windows that end after it are ``test``, those between are left out of
    both and not returned, as are windows without a target. ``features`` must not
    be missing; scale them on the training rows, as the ridge weighs them alike. A
    series without a training window has no predictions. Rows without a time or
    key are left out. A task holds one zone, or a few numbers per lag and series.
    """
    size, reach, keys = len(features), length - 1, list(order.keys)
    z = stage(_enter(df, order, features, target, length, steps, share), "windows")
    kinds = ", ".join(f"`{k}` {z.schema[k].dataType.simpleString()}" for k in keys)
    ends = z.where("_core").where((F.col("_pos") < reach) | (F.col("_pos") >= F.col("_end") - reach) & (F.col("_pos") < F.col("_end")))

    def solve(sums: pa.Table, rows: pa.Table) -> pa.Table:
        if not sums.num_rows:
            return pa.table({k: rows.column(k).slice(0, 0) for k in keys} | {"w": pa.array([], pa.list_(pa.float64())), "b": pa.array([], pa.float64())})
        flat = sums.sort_by("place").column("v").to_numpy()
        rows, x = _arrays(rows, features)
        pos, end = rows.column("_pos").to_numpy(), rows.column("_end")[0].as_py()
        at = lambda first: x[np.searchsorted(pos, np.arange(first, first + reach))]
        w, b = _solved(flat, at(0), at(end - reach), length, size, alpha)
        return pa.table({k: sums.column(k).slice(0, 1) for k in keys} | {"w": pa.array([w.ravel().tolist()], pa.list_(pa.float64())), "b": pa.array([b])})

    sums = _sums(z, order, features, length)
    fitted = sums.groupBy(*keys).cogroup(ends.groupBy(*keys)).applyInArrow(solve, f"{kinds}, w array<double>, b double")
    # one row per zone
    weights = z.where("_core").select(*keys, "_zone").distinct().join(fitted, keys)
    weights = weights.select(*(F.col(c).alias(c) for c in weights.columns))

    def predict(rows: pa.Table, fit: pa.Table) -> pa.Table:
        rows, x = _arrays(rows, features)
        if rows.num_rows and fit.num_rows:
            w = np.array(fit.column("w")[0].as_py()).reshape(length, size)
            out = np.full(len(x), np.nan)
            if len(x) >= length:
                out[reach:] = fit.column("b")[0].as_py() + sum(np.convolve(x[:, f], w[:, f], "valid") for f in range(size))
            pos = rows.column("_pos").to_numpy()
            kept = np.flatnonzero(rows.column("_core").to_numpy(zero_copy_only=False) & (pos >= reach))
        else:
            out, kept = np.zeros(0), np.zeros(0, int)
        part = rows.take(pa.array(kept, pa.int64()))
        return pa.table(
            {c: part.column(c) for c in (*keys, order.ts)}
            | {"row": part.column("_pos"), "_n": part.column("_n"), "_end": part.column("_end"), "actual": part.column("_y"), "predicted": pa.array(out[kept])}
        )

    time = z.schema[order.ts].dataType.simpleString()
    scored = z.groupBy(*keys, "_zone").cogroup(weights.groupBy(*keys, "_zone")).applyInArrow(
        predict, f"{kinds}, `{order.ts}` {time}, row long, _n long, _end long, actual double, predicted double"
    )
    split = F.when(F.col("row") < F.col("_end"), "train").when(F.col("row") >= F.floor(F.col("_n") * share), "test")
    scored = scored.withColumn("split", split).where("split IS NOT NULL AND actual IS NOT NULL")
    return scored.select(*keys, order.ts, "row", "split", "actual", "predicted")
