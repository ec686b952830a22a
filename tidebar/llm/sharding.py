"""Contiguous shards of equal bytes, cut from a global prefix sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import col, running_sums


def balanced_shards(df: DataFrame, n_shards: int, size: str, order: list[Column]) -> DataFrame:
    """Adds ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (place in the shard, from 0) to every row.

    Rows stand in ``order``; a row goes to the shard in whose equal share of the
    bytes its middle falls. Shards are contiguous, and their bytes differ by no
    more than the largest row. ``size`` is a long column, null counts as 0.

    Null keys stand first; equal keys and repeated rows stand in input order and
    may be cut anywhere. One row longer than a share leaves shards empty. An
    empty table gives an empty result. When all sizes are 0, all rows are in
    shard 0. The columns ``shard``, ``slot``, ``place``, ``first`` and those
    ending in ``_to`` must not be in ``df``.
    """
    ran = running_sums(df.withColumn("place", F.lit(1)), order, [size, "place"], "shards")
    total = ran.agg(F.max(f"{size}_to")).first()[0] or 0
    middle = 2 * col(f"{size}_to") - col(size)
    shard = F.floor(middle.cast("decimal(38,0)") * n_shards / F.lit(2 * max(total, 1)).cast("decimal(20,0)"))
    placed = ran.withColumn("shard", F.least(shard.cast("int"), F.lit(n_shards - 1)))
    # one row per shard
    firsts = placed.groupBy("shard").agg(F.min("place_to").alias("first"))
    out = placed.join(F.broadcast(firsts), "shard")
    return out.select(*(col(c) for c in df.columns), "shard", (F.col("place_to") - F.col("first")).alias("slot"))
