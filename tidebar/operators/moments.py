"""Regressions fitted to all rows up to a point, from centred moments that merge without cancellation.

The moments of a stretch of rows are its count, its means and the sums of
products of deviations from them. Two stretches merge into the moments of
both: to the sums comes a term with the difference of their means. All sums of
squares are then sums of non-negative terms, so a long series loses no digits,
as it does when squares of the raw values are summed and subtracted.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidebar.plans.zones import Order


def _pairs(values: list[str]) -> list[tuple[str, str]]:
    return list(combinations_with_replacement(values, 2))


def _sums(values: list[str]) -> list[str]:
    return ["_n", *(f"_m_{v}" for v in values), *(f"_c_{a}_{b}" for a, b in _pairs(values))]


def segment_moments(values: list[str]) -> list[Column]:
    """Aggregates ``_n``, ``_m_<v>``, ``_c_<a>_<b>`` over the rows that have all values; Spark merges partial ones as it should."""
    whole = F.lit(True)
    for v in values:
        whole = whole & F.col(v).isNotNull()
    x = {v: F.when(whole, F.col(v).cast("double")) for v in values}
    n = F.count(F.when(whole, 1))
    products = [(F.coalesce(F.covar_pop(x[a], x[b]) * n, F.lit(0.0))).alias(f"_c_{a}_{b}") for a, b in _pairs(values)]
    return [n.alias("_n"), *(F.avg(x[v]).alias(f"_m_{v}") for v in values), *products]


def _merge_term(a: str, b: str, n0: Column, n1: Column) -> Column:
    return F.coalesce(F.try_divide(n0 * n1, n0 + n1) * F.col(f"_d_{a}") * F.col(f"_d_{b}"), F.lit(0.0))


def accumulate(df: DataFrame, along: WindowSpec, values: list[str]) -> DataFrame:
    """Moments per row replaced by those of all rows up to it, in the order of ``along``.

    The mean of the rows before one is a running sum, taken from the first mean
    on; what merging adds to the sums of products is then known per row and is
    summed once more.
    """
    to, before = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({f"_r_{v}": F.first(f"_m_{v}", ignorenulls=True).over(to) for v in values})
    off = {v: F.coalesce(F.col("_n") * (F.col(f"_m_{v}") - F.col(f"_r_{v}")), F.lit(0.0)) for v in values}
    earlier = {"_b": F.coalesce(F.sum("_n").over(before), F.lit(0)), **{f"_s_{v}": F.coalesce(F.sum(off[v]).over(before), F.lit(0.0)) for v in values}}
    df = df.withColumns(earlier)
    df = df.withColumns({f"_d_{v}": F.col(f"_m_{v}") - F.col(f"_r_{v}") - F.coalesce(F.try_divide(f"_s_{v}", "_b"), F.lit(0.0)) for v in values})
    merged = {f"_c_{a}_{b}": F.sum(F.col(f"_c_{a}_{b}") + _merge_term(a, b, F.col("_b"), F.col("_n"))).over(to) for a, b in _pairs(values)}
    means = {f"_m_{v}": F.col(f"_r_{v}") + F.try_divide(F.col(f"_s_{v}") + off[v], F.col("_b") + F.col("_n")) for v in values}
    kept = [c for c in df.columns if c not in {*_sums(values), "_b"} and c[:3] not in {"_r_", "_s_", "_d_"}]
    return df.select(*kept, (F.col("_b") + F.col("_n")).alias("_n"), *(e.alias(n) for n, e in {**means, **merged}.items()))


def running_moments(z: DataFrame, order: Order, values: list[str], segment: Column, at_end: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """One row per (keys, ``by``, segment of a zone): moments of all core rows up to its end, and the aggregates ``at_end``.

    ``z`` is a zoned frame; segments are numbered in the order of the rows. Rows
    are folded to segments inside their zone, segments are accumulated inside the
    zone, zones along the series on a table with one row per zone. A segment that
    reaches over the border of a zone has a row in either.
    """
    group = [*order.keys, *by, "_zone"]
    parts = z.where("_core AND _pos IS NOT NULL").groupBy(*group, segment.alias("_segment")).agg(
        *segment_moments(values), *(c.alias(n) for n, c in at_end.items())
    )
    inside = Window.partitionBy(*group)
    local = accumulate(parts, inside.orderBy("_segment"), values)
    sums = _sums(values)
    ends = local.withColumn("_last", F.max("_segment").over(inside)).where("_segment = _last").select(*group, *sums)
    chain = Window.partitionBy(*order.keys, *by).orderBy("_zone")
    zoned = accumulate(ends, chain, values)
    earlier = zoned.select(*(F.col(g).alias(f"_k{g}") for g in group), *(F.lag(s).over(chain).alias(f"_e{s}") for s in sums))
    match = F.lit(True)
    for g in group:
        match = match & (F.col(g) == F.col(f"_k{g}"))
    out = local.join(earlier, match, "left").drop(*(f"_k{g}" for g in group))
    n0, n1 = F.coalesce(F.col("_e_n"), F.lit(0)), F.col("_n")
    out = out.withColumns({f"_d_{v}": F.col(f"_m_{v}") - F.col(f"_e_m_{v}") for v in values})
    means = {f"_m_{v}": F.coalesce(F.col(f"_e_m_{v}") + F.try_divide(n1, n0 + n1) * F.col(f"_d_{v}"), F.col(f"_e_m_{v}"), F.col(f"_m_{v}")) for v in values}
    merged = {
        f"_c_{a}_{b}": F.col(f"_c_{a}_{b}") + F.coalesce(F.col(f"_e_c_{a}_{b}"), F.lit(0.0)) + _merge_term(a, b, n0, n1) for a, b in _pairs(values)
    }
    kept = [*order.keys, *by, "_segment", *at_end]
    return out.select(*kept, (n0 + n1).alias("_n"), *(e.alias(n) for n, e in {**means, **merged}.items()))


def coefficients(df: DataFrame, x: list[str], y: str, ridge: float = 0.0, tolerance: float = 1e-12) -> DataFrame:
    """Adds ``_b_<x>`` and the intercept ``_b``: least squares of ``y`` on ``x`` by elimination of the centred moments.

    One projection per feature and no loop over rows. ``ridge`` is added to the
    squares. A feature that is constant or, to ``tolerance`` of its square, a
    combination of the ones before it has coefficient 0. With fewer rows than
    coefficients all are missing.
    """
    values = [*x, y]

    def product(a, b):
        return F.col(f"_c_{a}_{b}" if values.index(a) <= values.index(b) else f"_c_{b}_{a}")

    start = {f"_a{i}{j}": product(x[i], x[j]) + (ridge if i == j else 0.0) for i in range(len(x)) for j in range(i, len(x))}
    start |= {f"_y{i}": product(x[i], y) for i in range(len(x))}
    df = df.withColumns(start)
    for k in range(len(x)):
        pivot = F.col(f"_a{k}{k}")
        sound = pivot > tolerance * (product(x[k], x[k]) + ridge)
        df = df.withColumns({f"_p{k}": F.when(sound, pivot)})
        factor = {i: F.coalesce(F.try_divide(F.col(f"_a{k}{i}"), F.col(f"_p{k}")), F.lit(0.0)) for i in range(k + 1, len(x))}
        less = {f"_a{i}{j}": F.col(f"_a{i}{j}") - factor[i] * F.col(f"_a{k}{j}") for i in factor for j in range(i, len(x))}
        df = df.withColumns(less | {f"_y{i}": F.col(f"_y{i}") - f * F.col(f"_y{k}") for i, f in factor.items()})
    enough = F.col("_n") > len(x)
    for k in range(len(x) - 1, -1, -1):
        rest = F.col(f"_y{k}")
        for j in range(k + 1, len(x)):
            rest = rest - F.col(f"_a{k}{j}") * F.col(f"_b_{x[j]}")
        df = df.withColumns({f"_b_{x[k]}": F.when(enough, F.coalesce(F.try_divide(rest, F.col(f"_p{k}")), F.lit(0.0)))})
    level = F.col(f"_m_{y}")
    for v in x:
        level = level - F.col(f"_b_{v}") * F.col(f"_m_{v}")
    helpers = [*start, *(f"_p{k}" for k in range(len(x)))]
    return df.withColumns({"_b": level}).drop(*helpers)


def predicted(x: dict[str, Column]) -> Column:
    """The value at ``x``: feature name to column."""
    out = F.col("_b")
    for v, at in x.items():
        out = out + F.col(f"_b_{v}") * at
    return out


def running_line(z: DataFrame, order: Order, c: str, segment: Column, at_end: dict[str, Column]) -> DataFrame:
    """A line of ``c`` against the row position, for all rows up to the end of each segment."""
    z = z.withColumns({"_x": F.col("_pos").cast("double"), "_y": F.col(c)})
    return coefficients(running_moments(z, order, ["_x", "_y"], segment, at_end), ["_x"], "_y")
