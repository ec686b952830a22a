"""Joins of many rows with a table of one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.session import stage

SALTS = 16


def join_per_key(df: DataFrame, per_key: DataFrame, keys: tuple[str, ...], spread: str = "ts") -> DataFrame:
    """Left join on ``keys`` that stays even when one key holds much of ``df``; a key without a row gets NULLs.

    The rows of a key are spread over salted copies of its one row. Where Spark
    broadcasts the small side by its own size check, the copies cost nothing;
    where it shuffles, no task gets a whole key.
    """
    copies = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    rows = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    return rows.join(copies, [*keys, "_salt"], "left").drop("_salt")


def join_frequent(rows: DataFrame, per_key: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """Inner join of stored ``rows`` with a large table of one row per ``key``, of which some are very frequent in ``rows``.

    A sketch that merges over tasks finds the keys with more than ``1 / most`` of
    the rows, fewer than ``most``. Their rows of the table are stored by
    themselves, so that Spark's own size check sees how few they are and
    broadcasts them; the other rows are shuffled by a key of which none is frequent.
    """
    found = F.expr(f"approx_top_k(`{key}`, {most}, {20 * most})")
    total, top = rows.agg(F.count(key), found).first()
    often = [r["item"] for r in top or [] if r["count"] * most > total]
    if not often:
        return rows.join(per_key, key)
    is_often = F.col(key).isin(often)
    few = stage(per_key.where(is_often).coalesce(1), "frequent")
    return rows.where(is_often).join(few, key).unionByName(rows.where(~is_often).join(per_key.where(~is_often), key))


def join_configured(df: DataFrame, table: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """Join with a table whose keys come from the configuration: models, horizons, timeframes.

    Its size does not depend on the data, a few rows per model and horizon, so
    it is broadcast outright; a shuffle would gather all rows on those few keys.
    """
    return df.join(F.broadcast(table), list(keys), how)
