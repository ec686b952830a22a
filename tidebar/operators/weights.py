"""Weights of stacked predictions on the simplex (M12, X6): searched without trying every weighting on every row.

With weights that sum to 1 the error of a combination is the combination of the
models' errors. The mean square of all weightings then follows from one matrix
of mean error products per key. The mean absolute error is convex in the
weights: its value and slope at one weighting bound it from below at all others.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.session import stage

METRICS = ("mae", "rmse", "hybrid")
ALL = "_all"


@functools.cache
def simplex(models: int, parts: int) -> np.ndarray:
    """All ways to split ``parts`` over ``models``, in lexicographic order; divided by ``parts`` they are weights."""
    if models == 1:
        return np.array([[parts]])
    return np.concatenate([np.column_stack([np.full(len(rest := simplex(models - 1, parts - k)), k), rest]) for k in range(parts + 1)])


def _errors(df: DataFrame, models: list[str], actual: str, keys: tuple[str, ...]) -> DataFrame:
    """``e0`` .. per model: actual minus predicted. A row without all predictions counts as predicted 0, whatever the weights."""
    whole = F.lit(True)
    for m in models:
        whole = whole & F.col(m).isNotNull() & ~F.isnan(m)
    return df.select(*keys, *((F.col(actual) - F.when(whole, F.col(m)).otherwise(F.lit(0.0))).alias(f"e{i}") for i, m in enumerate(models)))


def error_products(df: DataFrame, models: list[str], actual: str = "actual", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n, products): mean products of the models' errors, by rows of their matrix. One aggregate with a partial step."""
    e = _errors(df, models, actual, keys).where(F.col("e0").isNotNull())
    size = range(len(models))
    means = {(i, j): F.avg(F.col(f"e{i}") * F.col(f"e{j}")).alias(f"p{i}_{j}") for i in size for j in size if i <= j}
    out = e.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *means.values())
    return out.where("n > 0").select(*keys, "n", F.array(*(F.col(f"p{min(i, j)}_{max(i, j)}") for i in size for j in size)).alias("products"))


def least_squares(products: np.ndarray) -> np.ndarray:
    """The weighting on the simplex with the least mean square error, by an active set.

    The models in the set get the weights that are best without bounds; the one
    that first turns negative on the way there leaves the set. When none does, the
    model outside whose gradient is lowest joins, until none promises less. Every
    step lowers the error, so no set comes back; a flat direction (equal models)
    is solved by least norm.
    """
    size = len(products)
    start = int(np.argmin(np.diag(products)))
    w, active = np.eye(size)[start], [start]
    scale = max(float(np.max(np.abs(products))), 1e-300)
    for _ in range(100 * size):
        part = products[np.ix_(active, active)]
        system = np.block([[part / scale, np.ones((len(active), 1))], [np.ones((1, len(active))), np.zeros((1, 1))]])
        best = np.linalg.lstsq(system, np.r_[np.zeros(len(active)), 1.0], rcond=1e-13)[0][:-1]
        step = best - w[active]
        down = step < -1e-15
        reach = np.min(np.where(down, w[active] / np.where(down, -step, 1.0), np.inf), initial=np.inf)
        if reach < 1:
            w[active] += reach * step
            gone = active[int(np.argmin(np.where(down, w[active], np.inf)))]
            w[gone] = 0.0
            active.remove(gone)
            continue
        w[active] = best
        gradient = products @ w
        worth = gradient - gradient @ w
        worth[active] = np.inf
        join = int(np.argmin(worth))
        if not worth[join] < -1e-12 * scale:
            break
        active = sorted([*active, join])
    w = np.clip(w, 0.0, None)
    return w / w.sum()


def _per_key(df: DataFrame, work, columns: str) -> DataFrame:
    """``work`` on each row of a table with one row per key; it gets a dict and gives a dict of new values."""
    names = [c.split()[0] for c in columns.split(", ")]
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, {columns}"

    def run(batches):
        for batch in batches:
            made = [work(r) for r in batch.to_pylist()]
            new = [pa.array([m[n] for m in made], pa.list_(pa.float64()) if "array" in c else pa.float64()) for n, c in zip(names, columns.split(", "))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, schema)


def exact_weights(df: DataFrame, models: list[str], actual: str = "actual", keys: tuple[str, ...] = ()) -> DataFrame:
    """M12 by root mean square, without a grid: (keys, ``w_<model>``, rmse). Rows without ``actual`` are left out."""

    def solve(row):
        matrix = np.array(row["products"]).reshape(len(models), -1)
        w = least_squares(matrix)
        return {"w": w.tolist(), "rmse": float(np.sqrt(max(w @ matrix @ w, 0.0)))}

    out = _per_key(error_products(df, models, actual, keys), solve, "w array<double>, rmse double")
    return out.select(*keys, *(F.col("w")[i].alias(f"w_{m}") for i, m in enumerate(models)), "rmse")


def _beside(rows: DataFrame, table: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``rows`` joined with a table of a few rows per key; without keys of the caller there is one key, and the table is broadcast."""
    return rows.join(F.broadcast(table) if keys == (ALL,) else table, list(keys))


def _evaluated(errors: DataFrame, asked: DataFrame, keys: tuple[str, ...], size: int) -> DataFrame:
    """(keys, id, mae, slope): mean absolute error of each asked weighting and its slope there."""
    rows = _beside(errors, asked, keys).select(*keys, *(f"e{i}" for i in range(size)), F.explode("ask").alias("ask"))
    combined = F.lit(0.0)
    for i in range(size):
        combined = combined + F.col("ask.w")[i] * F.col(f"e{i}")
    rows = rows.withColumn("r", combined).withColumn("id", F.col("ask.id"))
    out = rows.groupBy(*keys, "id").agg(F.avg(F.abs("r")).alias("mae"), *(F.avg(F.signum("r") * F.col(f"e{i}")).alias(f"g{i}") for i in range(size)))
    return out.select(*keys, "id", "mae", F.array(*(f"g{i}" for i in range(size))).alias("slope"))


class _Search:
    """What is known of one key's candidates: bounds from the evaluated ones."""

    def __init__(self, weights: np.ndarray, products: np.ndarray, metric: str, places: int):
        self.weights, self.metric, self.places = weights, metric, places
        self.rmse = np.sqrt(np.maximum(np.einsum("ki,ij,kj->k", weights, products, weights), 0.0))

    def score(self, mae, ids=slice(None)):
        return {"mae": mae, "rmse": self.rmse[ids], "hybrid": 0.5 * mae + 0.5 * self.rmse[ids]}[self.metric]

    def first(self, most: int) -> list[int]:
        """The best by mean square, the even weighting and the single models, as far as they are candidates."""
        even = int(np.argmin(((self.weights - 1 / self.weights.shape[1]) ** 2).sum(1)))
        singles = np.argmax(self.weights, axis=0).tolist()
        return list(dict.fromkeys([int(np.argmin(self.rmse)), even, *singles]))[:most]

    def best(self, ids: np.ndarray, mae: np.ndarray) -> int:
        """Place among the evaluated ones of the least rounded score; ties go to the first candidate."""
        return min(range(len(ids)), key=lambda k: (round(float(self.score(mae, ids)[k]), self.places), ids[k]))

    def next(self, ids: np.ndarray, mae: np.ndarray, slopes: np.ndarray, most: int) -> list[int]:
        """Up to ``most`` candidates that may still be better, those with the lowest bound and apart from each other."""
        low = self.score(np.max(self.weights @ slopes.T, axis=1))
        at = self.best(ids, mae)
        best = round(float(self.score(mae, ids)[at]), self.places)
        half = 0.5 * 10.0**-self.places
        open_ = low < best - half
        open_[: ids[at]] |= low[: ids[at]] <= best + half
        open_[ids] = False
        left = np.flatnonzero(open_)
        left = left[np.argsort(low[left], kind="stable")]
        picked: list[int] = []
        for apart in (0.4, 0.2, 0.0):
            for k in left.tolist():
                if len(picked) >= most:
                    return picked
                if k not in picked and all(np.abs(self.weights[k] - self.weights[j]).sum() >= apart for j in picked):
                    picked.append(k)
                if k == left[min(len(left), 400) - 1]:
                    break
        return picked


def optimise_weights(
    df: DataFrame, models: list[str], metric: str = "mae", parts: int = 10, actual: str = "actual",
    keys: tuple[str, ...] = (), places: int = 9, finer: int | None = None, candidates_a_round: int = 8,
) -> DataFrame:
    """Best weights in [0, 1] that sum to 1, on a grid of ``1/parts``; ``metric`` mae, rmse or hybrid. X6 with a period in ``keys``.

    The result is that of trying every weighting of the grid: the least score,
    rounded to ``places``, the first in lexicographic order among equals. Mean
    squares come from :func:`error_products`. For the absolute error each round
    evaluates a few weightings per key that could still win; their values and
    slopes bound all others from below, and a key is done when no bound is below
    its best value. Rows are read once a round, each at most
    ``candidates_a_round`` times, and only those of keys not done.

    With ``finer`` a second grid, that many times as dense, is searched within
    one step of the first one's winner. Rows without ``actual`` are left out;
    a key without rows has no result.
    """
    if metric not in METRICS:
        raise ValueError("metric is 'mae', 'rmse' or 'hybrid'")
    if not keys:
        out = optimise_weights(df.withColumn(ALL, F.lit(0)), models, metric, parts, actual, (ALL,), places, finer, candidates_a_round)
        return out.drop(ALL)
    size = len(models)
    products = stage(error_products(df, models, actual, keys), "weight-products")
    errors = stage(_errors(df, models, actual, keys).where(F.col("e0").isNotNull()), "weight-errors")
    out = _best_of_grid(errors, products, size, metric, places, keys, candidates_a_round, None, parts)
    if finer:
        centres = stage(out.select(*keys, F.col("w").alias("centre")), "weight-centres")
        near = _beside(products, centres, keys)
        out = _best_of_grid(errors, near, size, metric, places, keys, candidates_a_round, parts * finer, finer)
    return out.select(*keys, *(F.col("w")[i].alias(f"w_{m}") for i, m in enumerate(models)), "mae", "rmse", "score")


def _around(centre: np.ndarray, total: int, reach: int) -> np.ndarray:
    """Weightings in steps of ``1/total``, all but the last at most ``reach`` steps from ``centre``, in lexicographic order."""
    middle = np.rint(np.array(centre) * total).astype(int)
    axes = [np.arange(max(0, k - reach), min(total, k + reach) + 1) for k in middle[:-1]]
    free = np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, len(axes))
    last = total - free.sum(1)
    return np.column_stack([free, last])[(last >= 0) & (last <= total)] / total


def _best_of_grid(errors, products, size, metric, places, keys, most, total, steps) -> DataFrame:
    """(keys, w, mae, rmse, score) over the grid of ``1/steps``, or over that of ``1/total`` within ``steps`` of column ``centre``."""

    def search(row) -> _Search:
        weights = simplex(size, steps) / steps if total is None else _around(row["centre"], total, steps)
        return _Search(weights, np.array(row["products"]).reshape(size, size), metric, places)

    given = [*keys, *(c for c in ("products", "centre") if c in products.columns)]
    key_fields = [f for f in products.schema.fields if f.name in keys]
    key_schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in key_fields)
    ask_type = "array<struct<id:int,w:array<double>>>"

    def asked(rows: pa.Table, choose) -> pa.Table:
        """One row per key: its next candidates."""
        row = rows.slice(0, 1).to_pylist()[0]
        known = search(row)
        ids = choose(known, rows)
        columns = [pa.array([row[k]], rows.schema.field(k).type) for k in keys]
        kind = pa.list_(pa.struct([("id", pa.int32()), ("w", pa.list_(pa.float64()))]))
        columns.append(pa.array([[{"id": i, "w": known.weights[i].tolist()} for i in ids]], kind))
        return pa.Table.from_arrays(columns, names=[*keys, "ask"])

    def values(rows: pa.Table):
        return rows.column("id").to_numpy().astype(int), rows.column("mae").to_numpy(), np.array(rows.column("slope").to_pylist())

    first = products.select(*given).groupBy(*keys).applyInArrow(
        lambda rows: asked(rows, lambda known, _: known.first(most) if metric != "rmse" else [known.best(np.arange(len(known.weights)), known.rmse)]),
        f"{key_schema}ask {ask_type}",
    )
    ask, done = stage(first, "weight-asked"), None
    while True:
        new = _evaluated(errors, ask, keys, size)
        done = stage(new if done is None else done.unionByName(new), "weight-evaluated")
        if metric == "rmse":
            break
        step = _beside(products.select(*given), done, keys).groupBy(*keys).applyInArrow(lambda rows: asked(rows, lambda known, r: known.next(*values(r), most)), f"{key_schema}ask {ask_type}")
        ask = stage(step.where(F.size("ask") > 0), "weight-asked")
        if ask.isEmpty():
            break
    def winner(rows: pa.Table) -> pa.Table:
        row = rows.slice(0, 1).to_pylist()[0]
        known = search(row)
        ids, mae, _ = values(rows)
        at = known.best(ids, mae)
        columns = [pa.array([row[k]], rows.schema.field(k).type) for k in keys]
        score = round(float(known.score(mae, ids)[at]), places)
        columns += [pa.array([known.weights[ids[at]].tolist()], pa.list_(pa.float64())), *(pa.array([float(v)]) for v in (mae[at], known.rmse[ids[at]], score))]
        return pa.Table.from_arrays(columns, names=[*keys, "w", "mae", "rmse", "score"])

    return _beside(products.select(*given), done, keys).groupBy(*keys).applyInArrow(winner, f"{key_schema}w array<double>, mae double, rmse double, score double")
