"""How the filters of a pipeline interact: contractions of a contingency tensor per part of the corpus."""

from __future__ import annotations

from itertools import permutations
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import col, whole, words

PASS, FAIL, ALL = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def copies_of_smaller(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` with ``copy``: whether a row of smaller key, anywhere in the table, has the same text.

    Texts meet by their SHA-256, a null one as the empty one. Rows of equal or
    null keys are no smaller ones, and a null key has none below it. Per digest
    only the smallest key is gathered; digests of a single key are not joined.
    """
    digest = F.unhex(F.sha2(whole(text), 256))
    held = df.withColumn("_digest", digest)
    lowest = held.groupBy("_digest").agg(F.min(col(key)).alias("_low"), F.max(col(key)).alias("_high"))
    shared = lowest.where("_low < _high").select(F.col("_digest").alias("_same"), "_low")
    out = held.join(shared, F.col("_digest") == F.col("_same"), "left")
    return out.withColumn("copy", F.coalesce(col(key) > F.col("_low"), F.lit(False))).drop("_digest", "_same", "_low")


def text_filters(text: str) -> dict[str, Column]:
    """Conditions of failure that a text alone decides: few words, few distinct words, capitals, symbols."""
    found, given = words(whole(text)), whole(text)
    n = F.size(found)
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(found)) < 80 * n,
        "C": 100 * F.length(F.regexp_replace(given, "[^A-Z]+", "")) > 10 * F.length(given),
        "D": given.rlike(r"[#$%&*|]"),
    }


def contract(tensors: np.ndarray, selectors: list[np.ndarray]) -> np.ndarray:
    """Per tensor (first axis) the sum of its cells under one selector for each further axis."""
    axes = ascii_lowercase[1 : len(selectors) + 1]
    return np.einsum(f"a{axes},{','.join(axes)}->a", tensors, *selectors)


def steps(tensors: np.ndarray, names: str):
    """(order, step, counts by name, the step's filter) for every order of the filters and each step in it.

    ``tensors``: documents, good and toxic ones, each counted in 2 x ... x 2 cells, 1 on an axis for a failure of that filter.
    """
    n = len(names)
    every = contract(tensors, [ALL] * n)
    for order in permutations(range(n)):
        left = every
        for k, f in enumerate(order):
            before = [PASS if i in order[:k] else ALL for i in range(n)]
            removed = contract(tensors, [FAIL if i == f else s for i, s in enumerate(before)])
            failing = contract(tensors, [FAIL if i == f else ALL for i in range(n)])
            alone = contract(tensors, [FAIL if i == f else PASS for i in range(n)])
            left = left - removed
            counts = (left[0], removed[0], failing[0] - removed[0], alone[0], removed[1], removed[2])
            yield "".join(names[i] for i in order), k + 1, dict(zip(COUNTS, map(int, counts))), f


def audit(df: DataFrame, part: Column, fails: dict[str, Column], good: Column, toxic: Column) -> DataFrame:
    """One row per part, order of the filters and step: what each step keeps and removes, and what that costs.

    ``fails`` has up to eight filters by one-letter names, each a boolean column
    that is true where a row fails (null: passes); ``good`` and ``toxic`` mark rows
    (null: no). Tasks count rows by (part, failures), so that a shuffle carries at
    most 2^filters rows per part and task, and a part's counts, reshaped to a
    tensor with an axis of length two per filter, are contracted by selectors: of
    the earlier filters the passing half, of the step's own the failing one, of
    the later ones all.

    Columns: ``part``, ``filter_order``, ``step`` (from 1), ``kept``, ``removed``,
    ``redundant`` (failing, but removed earlier), ``unique_fails`` (failing this
    filter only), ``good_lost``, ``toxic_lost`` and ``shapley`` (removed by the
    filter, summed over all orders). Repeated rows count one by one; an empty
    table gives an empty result. A null part is a part of its own.
    """
    names = "".join(fails)
    if len(names) != len(fails) or not 1 <= len(names) <= 8:
        raise ValueError("one to eight filters with names of one letter")
    bits = [F.when(fail, 1 << (len(names) - 1 - i)).otherwise(0) for i, fail in enumerate(fails.values())]
    coded = df.select(part.alias("part"), sum(bits[1:], bits[0]).cast("int").alias("cell"), good.alias("good"), toxic.alias("toxic"))
    marked = [F.count("*").alias("n"), *(F.count(F.when(F.col(c), 1)).alias(f"n_{c}") for c in ("good", "toxic"))]
    cells = coded.groupBy("part", "cell").agg(*marked)
    kind = coded.schema["part"].dataType.simpleString()

    def per_part(rows: pa.Table) -> pa.Table:
        flat = np.zeros((3, 1 << len(names)), np.int64)
        flat[:, rows.column("cell").to_numpy()] = [rows.column(c).to_numpy() for c in ("n", "n_good", "n_toxic")]
        found = list(steps(flat.reshape(3, *[2] * len(names)), names))
        shapley = np.bincount([f for *_, f in found], [c["removed"] for *_, c, _ in found], len(names)).astype(np.int64)
        columns = {
            "part": pa.array([rows.column("part")[0].as_py()] * len(found), rows.schema.field("part").type),
            "filter_order": pa.array([o for o, *_ in found], pa.string()),
            "step": pa.array([k for _, k, *_ in found], pa.int32()),
            **{c: pa.array([x[c] for *_, x, _ in found], pa.int64()) for c in COUNTS},
            "shapley": pa.array([int(shapley[f]) for *_, f in found], pa.int64()),
        }
        return pa.table(columns)

    longs = ", ".join(f"{c} long" for c in (*COUNTS, "shapley"))
    return cells.groupBy("part").applyInArrow(per_part, f"part {kind}, filter_order string, step int, {longs}")
