"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import col, running_sums
from tidebar.session import stage


def fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Adds ``target`` to sources (``weight`` double, ``total`` long): shares of ``budget`` by weight, none above
    ``max_epochs`` times its total.

    Sources above their limit are clamped there and what they leave is shared by
    the others' weights, round by round, until no other source is above. A round
    is one aggregate of the source table, of which the driver sees one row.
    """
    limit, weight = F.col("total") * F.lit(float(max_epochs)), F.col("weight")
    level, clamped = 0.0, -1
    while True:
        over = limit < weight * F.lit(level) if clamped >= 0 else F.lit(False)
        row = sources.agg(
            F.count(F.when(over, 1)).alias("n"),
            F.coalesce(F.sum(F.when(over, limit)), F.lit(0.0)).alias("spent"),
            F.coalesce(F.sum(F.when(~over, weight)), F.lit(0.0)).alias("weight"),
        ).first()
        if row["n"] == clamped or not row["weight"]:
            level = level if row["weight"] else float("inf")
            break
        clamped, level = row["n"], (budget - row["spent"]) / row["weight"]
    target = limit if level == float("inf") else F.least(limit, weight * F.lit(level))
    return sources.withColumn("target", target.cast("double"))


def cycled(weights: tuple[float, ...]):
    """Weights that repeat over the sources in code point order, null last."""

    def assign(place: Column) -> Column:
        return F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((place - 1) % len(weights) + 1).cast("int"))

    return assign


def _places(seed: int, key: list[str], ties: tuple[str, ...]) -> list[Column]:
    """What orders the rows of a source: the hash, then the columns themselves."""
    return [F.xxhash64(F.lit(seed), *(col(k) for k in key)), *(col(k) for k in (*key, *ties))]


def mix(
    df: DataFrame, source: str, size: str, weight, key: list[str], share: float = 1.0, max_epochs: float = 3.0, seed: int = 42,
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``times`` to every row: how often the mix takes it.

    The budget is ``share`` of all sizes, split by :func:`fill`; ``weight`` maps a
    source's place in code point order (from 1, null last) to its weight. A
    source is taken as often as its target holds it whole; what is left over is
    taken from its rows in an order seeded by ``seed`` and the ``key`` columns, up
    to the row whose middle reaches it. A source's words miss its target by half
    a row at most, and no row is taken more than ``max_epochs`` times, rounded up.

    The order is a global one over (source, hash), dealt in ranges, so a source
    with a third of all rows is spread over a third of the tasks. Rows of size 0
    and of sources without words are taken as the whole part says. Null
    sources form one source; repeated rows are taken one by one. An empty table
    gives an empty result. The names this adds, ``drawn`` and ``<size>_to`` must
    not be in ``df``.
    """
    places = _places(seed, key, ties)
    order = [col(source).asc_nulls_last(), F.col("drawn"), *places[1:]]
    ran = running_sums(df.withColumn("drawn", places[0]), order, [size], "mix")
    end = col(f"{size}_to")
    sources = ran.groupBy(col(source).alias("of")).agg(F.sum(col(size)).alias("total"), F.min(end - col(size)).alias("start"))
    placed = running_sums(sources.withColumn("place", F.lit(1)), [F.col("of").asc_nulls_last()], ["place"], "mix-sources")
    weighed = placed.withColumn("weight", weight(F.col("place_to")))
    budget = float(weighed.agg(F.sum("total")).first()[0] or 0) * share
    targets = fill(weighed, budget, max_epochs).select("of", "total", "start", "target")
    out = ran.join(targets, col(source).eqNullSafe(F.col("of")))
    whole = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(F.lit(0))
    rest = F.col("target") - whole * F.col("total")
    middle = end - F.col("start") - col(size) / 2
    times = whole + F.when(middle < rest, 1).otherwise(0)
    return out.select(
        *(col(c) for c in df.columns), F.col("total").alias("source_size"), "target", times.cast("long").alias("times")
    )


def times(
    df: DataFrame, source: str, size: str, weight, key: list[str], row: str, share: float = 1.0, max_epochs: float = 3.0, seed: int = 42
) -> DataFrame:
    """(``times``, columns of ``df``): the counts of :func:`mix`, rows equal in ``key`` told apart by the unique column ``row``.

    For a stored ``df`` with wide columns, which are not shuffled: a source's
    rows with one time more come first in its order, so the first row of those
    with the lowest count, one per source, tells for every row how often it is
    taken. Spark broadcasts that table by its own size check. The names ``times``,
    ``of`` and ``edge`` must not be in ``df``.
    """
    mixed = mix(df.select(*(col(c) for c in dict.fromkeys((source, size, *key, row)))), source, size, weight, key, share, max_epochs, seed, (row,))
    places = _places(seed, key, (row,))
    place = F.struct(*(c.alias(f"p{i}") for i, c in enumerate(places)))
    edges = stage(mixed.groupBy(col(source).alias("of")).agg(F.min(F.struct("times", place.alias("place"))).alias("edge")), "mix-edges")
    out = df.join(edges, col(source).eqNullSafe(F.col("of")))
    more = F.when(place < F.col("edge.place"), 1).otherwise(0)
    return out.select((F.col("edge.times") + more).cast("long").alias("times"), *(col(c) for c in df.columns))
