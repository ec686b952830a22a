"""Exponentially weighted mean as a two-level scan.

``y0 = x0; y_t = a*x_t + q*y_{t-1}`` with ``a = 2/(span+1)``, ``q = 1-a`` equals
``y_p = sum_j u_j * q^(p-j)`` with ``u_0 = x_0`` and ``u_j = a*x_j``. Inside a
cell (a run of positions within a zone) that is a running sum of ``u_j * q^-j``
times ``q^p``, with exponents centred on the cell so that nothing overflows.
Between cells one value per cell is carried. The carry looks back until
``q^distance`` is exactly 0.0 in double precision, so every term that can
change the result is in the sum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.plans import zones
from tidebar.plans.zones import Carry, Order

UNDERFLOW = 745.2  # exp(-745.2) is 0.0 in double precision
EXPONENT_LIMIT = 600.0  # stay clear of the overflow at exp(709)


def decay(span: float) -> float:
    if span < 1:
        raise ValueError("span must be at least 1")
    return 1.0 - 2.0 / (span + 1.0)


def cell_rows(z: DataFrame, order: Order, spans) -> int:
    """Longest local run whose centred powers stay in range for the fastest decay."""
    rows = zones.zone_rows(z.sparkSession, order)
    rates = [-math.log(decay(s)) for s in spans if s > 1]
    return max(1, min([rows] + [int(2 * EXPONENT_LIMIT / r) for r in rates]))


def add_ewm(carry: Carry, out: str, column: str, span: float) -> None:
    """Add one mean to ``carry``, which must have been made with ``cell_rows``."""
    q, cell = decay(span), carry.cell
    if q == 0:
        carry.add(out, F.col(column), F.lit(0.0), F.lit(0.0), F.col(f"_l_{out}"))
        return
    qc = F.lit(q)
    e = F.col("_pos") - F.col("_cell") * cell - cell // 2
    u = F.when(F.col("_pos") == 0, F.col(column)).otherwise(F.lit(1 - q) * F.col(column))
    u = F.when(F.col("_core"), u * F.pow(qc, -e)).otherwise(0.0)
    horizon = UNDERFLOW / -math.log(q)
    # zones start in distinct runs of `rows` positions, which bounds the splits on the way back
    rows = zones.zone_rows(carry.z.sparkSession, carry.order)
    reach = math.ceil(horizon / cell) + math.ceil(horizon / rows) + 3
    earlier = F.collect_list(F.struct(F.col(f"_t_{out}").alias("v"), F.col("_end").alias("end"))).over(
        carry.chain.rowsBetween(-reach, -1)
    )
    carry.add(
        out,
        F.sum(u).over(carry.run) * F.pow(qc, e),
        F.max_by(f"_l_{out}", "_pos"),
        F.aggregate(earlier, F.lit(0.0), lambda acc, s: acc + s["v"] * F.pow(qc, F.col("_start") - s["end"])),
        F.col(f"_l_{out}") + F.pow(qc, F.col("_pos") - F.col("_start") + 1) * F.col(f"_c_{out}"),
    )


def ewm_carry(z: DataFrame, order: Order, means: dict[str, tuple[str, float]]) -> Carry:
    """``out -> (column, span)`` on a zoned frame, open for more values. Input must not be NULL."""
    carry = Carry(z, order, cell_rows(z, order, [s for _, s in means.values()]))
    for out, (column, span) in means.items():
        add_ewm(carry, out, column, span)
    return carry


def ewm_zoned(z: DataFrame, order: Order, means: dict[str, tuple[str, float]]) -> DataFrame:
    return ewm_carry(z, order, means).apply()


def ewm(df: DataFrame, order: Order, means: dict[str, tuple[str, float]]) -> DataFrame:
    """Add exponentially weighted means to a frame with a written, non-NULL input."""
    return zones.leave(ewm_zoned(zones.enter(df, order), order, means))


def mean_of_mean(inner: str, outer: str, inner_span: float, outer_span: float) -> Column:
    """Mean with ``outer_span`` of the mean with ``inner_span``, from both means of the same input.

    With decays f and g, ``((1-f)*g*outer - (1-g)*f*inner) / (g-f)`` satisfies
    the recurrence of the nested mean and starts at the same value, so a nested
    mean needs no second pass over the rows. The spans must differ.
    """
    f, g = decay(inner_span), decay(outer_span)
    return (F.lit((1 - f) * g) * F.col(outer) - F.lit((1 - g) * f) * F.col(inner)) / F.lit(g - f)
