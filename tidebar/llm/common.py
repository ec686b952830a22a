"""Pieces several operators share: words, running sums over a global order, connected components."""

from __future__ import annotations

import gc
import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.session import discard, stage

#: Separators between words, and a word, in Java's and Python's regular expressions.
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def col(name: str) -> Column:
    """A top-level column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(text: str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(col(text), F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def importable(spark) -> None:
    """Lets Python workers import this package from where the driver does; a cluster that has it installed needs no such path."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (root, *paths) if p)


def small(batches, rows: int = 512):
    """The batches in pieces of so many rows: Python then holds the objects of one piece, not of a whole batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def settle(spark, paths: list[str]) -> None:
    """Deletes stored tables that are done with, and lets Spark remove the shuffle files of plans nobody holds any more."""
    discard(spark, paths)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_sums(df: DataFrame, order: list[Column], sums: list[str], name: str) -> DataFrame:
    """Adds ``<sum>_to``, the sum over all rows up to this one in a global order, for each named long column.

    Rows are dealt in ranges of ``order``; each range sums its own rows, and the
    totals of the ranges before it, one row per partition, are added. Rows that
    are equal in ``order`` are told apart by their place in the input, so that
    any number of them spreads over several ranges. Null counts as 0.
    """
    tie = F.monotonically_increasing_id().alias("tie")
    columns = [F.coalesce(col(c), F.lit(0)).cast("long").alias(c) if c in sums else col(c) for c in df.columns]
    tied = df.select(*columns, tie)
    dealt = tied.repartitionByRange(partitions(df), *order, F.col("tie")).sortWithinPartitions(*order, "tie")
    fields, local = dealt.schema.fields, [f"{s}_local" for s in sums]
    places = {s: dealt.columns.index(s) for s in sums}
    dealt = dealt.toDF(*(f"c{i}" for i in range(len(fields))))  # names of the caller may hold dots
    schema = T.StructType(
        [*fields, T.StructField("range", T.IntegerType()), *(T.StructField(s, T.LongType()) for s in local)]
    )

    def scan(batches):
        at, before = TaskContext.get().partitionId(), [0] * len(sums)
        for batch in batches:
            ends = []
            for i, s in enumerate(sums):
                end = np.cumsum(batch.column(places[s]).to_numpy(zero_copy_only=False)) + before[i]
                before[i] = int(end[-1]) if len(end) else before[i]
                ends.append(pa.array(end, pa.int64()))
            place = pa.array(np.full(batch.num_rows, at, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, place, *ends], names=[*(f.name for f in fields), "range", *local])

    ranged = stage(dealt.mapInArrow(scan, schema), name)
    totals = ranged.groupBy("range").agg(*(F.max(s).alias(s) for s in local))
    # one row per range: a table as long as the number of partitions
    before = totals.selectExpr(
        "range", *(f"coalesce(sum({s}) OVER (ORDER BY range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS {s}_before" for s in local)
    )
    out = ranged.join(F.broadcast(before), "range")
    return out.select(
        *(col(c) for c in df.columns), *((F.col(f"{s}_local") + F.col(f"{s}_local_before")).alias(f"{s}_to") for s in sums)
    )


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b: long); root is the smallest node reachable.

    Alternating large and small stars: every node points its neighbours at the
    smallest node it knows, until each component is one star. The number of
    rounds grows with the logarithm of the longest path. A node with very many
    neighbours is a skewed join key between two stored tables, which Spark
    splits; nothing is gathered per node but a minimum.
    """
    spark = edges.sparkSession
    a, b = F.col("a"), F.col("b")
    now = stage(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), f"{name}-edges")

    def lowest(pairs: DataFrame) -> DataFrame:
        return stage(pairs.groupBy("a").agg(F.min("b").alias("m")), f"{name}-lowest")

    def signature(pairs: DataFrame):
        return pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    seen = signature(now)
    while seen[0]:
        both = now.union(now.select(b.alias("a"), a.alias("b")))
        low = lowest(both)
        large = both.where(b > a).join(low, "a").select(b.alias("a"), F.least("m", "a").alias("b"))
        large = stage(large.distinct(), f"{name}-large")
        low = lowest(large)
        small = large.join(low, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        now = stage(small.union(low.select("a", F.col("m").alias("b"))).distinct(), f"{name}-small")
        last, seen = seen, signature(now)
        if seen == last:
            break
    roots = now.select(b.alias("node"), b.alias("root")).distinct()
    return stage(now.select(a.alias("node"), b.alias("root")).union(roots), f"{name}-roots") if seen[0] else (
        spark.createDataFrame([], "node long, root long")
    )
