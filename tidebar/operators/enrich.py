"""Joining other series to bars in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.plans import zones
from tidebar.plans.zones import Order


def asof_enrich(
    left: DataFrame, right: DataFrame, columns: list[str], on: tuple[str, ...], order: Order | None = None
) -> DataFrame:
    """X1, both sides keyed: the latest ``right`` row at or before each ``left`` row of the same keys.

    Both sides become one ordered frame whose missing values are filled
    forward, and the left rows are kept. Zones split it by time, so a long
    series is spread over tasks; left rows of one instant stand after the right
    ones, in the order of a hash, by which many of them can be split too. Without
    ``order`` the density is measured on both sides. A left row without a time or
    key, or before the first right row, gets NULLs.
    """
    after = F.pmod(F.xxhash64(*left.columns), F.lit(1 << 62)) + 1
    both = left.withColumn("_side", after).unionByName(
        right.select(*on, "ts", *columns).withColumn("_side", F.lit(0).cast("long")), allowMissingColumns=True
    )
    # a struct marks presence, so a missing value in the latest right row stays missing
    both = both.withColumn("_match", F.when(F.col("_side") == 0, F.struct(*columns)))
    order = order or zones.fit(both, Order(keys=tuple(on)))
    order = Order(order.step, tuple(on), "ts", ("_side",), order.rows)
    z = zones.fill_forward(zones.enter(both, order), order, {"_match": "_match"})
    z = z.where(F.col("_side") > 0).withColumns({c: F.col(f"_match.{c}") for c in columns})
    return zones.leave(z).drop("_side", "_match")


def asof_calendar(left: DataFrame, right: DataFrame, columns: list[str], order: Order | None = None) -> DataFrame:
    """X1, right side without keys: a series, such as a macro value, that applies to every left row.

    All left series share one line of time with the right side. A row is in one
    zone and meets the right rows in it and the last one before it, however
    dense either side is; no pairs are made.
    """
    shared = order and Order(order.step, ("_all",), "ts", (), order.rows)
    out = asof_enrich(left.withColumn("_all", F.lit(0)), right.withColumn("_all", F.lit(0)), columns, ("_all",), shared)
    return out.drop("_all")
