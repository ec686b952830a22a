"""Near-duplicate vectors by an inverted multi-index."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import col, components
from tidebar.llm.simhash import joined
from tidebar.session import stage


TURNS = 4  # with 256 queries over a thousand measured pairs


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # or the squares of very small ones vanish
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def matrix(column, width: int) -> np.ndarray:
    """Rows of an Arrow list column; shorter ones end in zeros."""
    values, offsets = column.flatten().to_numpy(zero_copy_only=False), np.diff(np.r_[0, np.cumsum([len(x) for x in column])])
    out = np.zeros((len(column), width))
    out[np.arange(width) < offsets[:, None]] = values
    return out


def squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all centres."""
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1), 0)


def codebook(points: np.ndarray, n: int, rounds: int = 12, seed: int = 42) -> np.ndarray:
    """Centres of ``n`` or fewer clusters (Lloyd's rounds from a seeded choice of distinct points)."""
    points = np.unique(points, axis=0)
    centres = points[np.random.default_rng(seed).permutation(len(points))[:n]]
    for _ in range(rounds):
        nearest = squares(points, centres).argmin(1)
        size = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


class Grid:
    """Product of two codebooks, one for each half of a unit vector; a cell is a pair of centres."""

    def __init__(self, sample: np.ndarray, n: int):
        self.cut = sample.shape[1] // 2
        self.first, self.second = codebook(sample[:, : self.cut], n), codebook(sample[:, self.cut :], n)

    def distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squares(vectors[:, : self.cut], self.first), squares(vectors[:, self.cut :], self.second)

    def cells(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def nearest(self, a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
        """The n cells nearest to one vector, in order: the multi-sequence traversal of its two sorted distances."""
        i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        x, y, out = a[i].tolist(), b[j].tolist(), []
        queue, seen = [(x[0] + y[0], 0, 0)], {(0, 0)}
        while queue and len(out) < n:
            _, p, q = heapq.heappop(queue)
            out.append(int(i[p]) * len(y) + int(j[q]))
            for to in ((p + 1, q), (p, q + 1)):
                if to[0] < len(x) and to[1] < len(y) and to not in seen:
                    seen.add(to)
                    heapq.heappush(queue, (x[to[0]] + y[to[1]], *to))
        return out

    def rank(self, a: np.ndarray, b: np.ndarray, cell: int) -> int:
        """How many cells a vector's traversal has visited when it reaches ``cell``."""
        total = a[cell // len(self.second)] + b[cell % len(self.second)]
        return int(np.searchsorted(np.sort(b), total - a + 1e-12, side="right").sum())


def turned(vectors: np.ndarray, cosine: float, random) -> np.ndarray:
    """Unit vectors at this cosine to the given ones, in random directions; a vector of one component stays."""
    away = random.normal(size=vectors.shape)
    away -= (away * vectors).sum(1, keepdims=True) * vectors
    length = np.linalg.norm(away, axis=1, keepdims=True)
    return np.where(length > 1e-9, cosine * vectors + np.sqrt(1 - cosine**2) * away / np.maximum(length, 1e-9), vectors)


def fit(distinct: DataFrame, n: int, width: int, threshold: float, recall: float, sample: int, queries: int, most: int):
    """A grid, and the number of cells a search visits for the target recall.

    The codebooks are fitted on about ``sample`` vectors taken by hash, of sqrt(n / 24)
    centres each (``most`` at most). About ``queries`` of them are compared with all
    vectors; the traversal ranks of the neighbours found give the number of cells.
    Where few or none have neighbours, that says little: each is also turned
    ``TURNS`` times by the largest angle that still links, and the ranks at which
    the turned ones reach the cell of the vector count likewise.
    """
    part = F.pmod(F.xxhash64("embedding"), F.lit(1 << 30))
    rows = distinct.where(part < int((1 << 30) * min(1.0, sample / n))).select("embedding").toArrow().column("embedding")
    if not len(rows):
        rows = distinct.select("embedding").limit(1).toArrow().column("embedding")
    known = unit(matrix(rows.combine_chunks(), width))
    grid = Grid(known, int(np.clip(np.ceil(np.sqrt(n / 24)), 1, most)))
    random = np.random.default_rng(7)
    asked = known[random.permutation(len(known))[:queries]]
    a, b = grid.distances(asked)
    cells = np.tile(grid.cells(a, b), TURNS)
    c, d = grid.distances(turned(np.tile(asked, (TURNS, 1)), threshold, random))
    reached = np.sort([grid.rank(c[i], d[i], int(cell)) for i, cell in enumerate(cells)])

    def ranks(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = unit(matrix(batch.column("embedding"), width))
            cells = grid.cells(*grid.distances(vectors))
            cosine = asked @ vectors.T
            found: dict[int, int] = {}
            for q in np.flatnonzero(((cosine >= threshold) & (cosine < 1 - 1e-12)).any(1)):
                near, times = np.unique(cells[(cosine[q] >= threshold) & (cosine[q] < 1 - 1e-12)], return_counts=True)
                for cell, k in zip(near, times):
                    r = grid.rank(a[q], b[q], int(cell))
                    found[r] = found.get(r, 0) + int(k)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["rank", "n"])

    seen = distinct.select("embedding").mapInArrow(ranks, "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n")).orderBy("rank").collect()
    total, so_far = sum(r["n"] for r in seen), 0
    visits = max(8, int(reached[int(np.ceil(recall * len(reached))) - 1]))
    for r in seen:
        so_far += r["n"]
        visits = max(visits, r["rank"])
        if so_far >= recall * total:
            break
    return grid, min(visits, len(grid.first) * len(grid.second))


def near_duplicates(
    df: DataFrame, key: str, vector: str, threshold: float = 0.95, recall: float = 0.98, sample: int = 20_000, queries: int = 256, most: int = 512, block: int = 2048
) -> DataFrame:
    """(key, n_links, component, kept) per row: the vectors linked directly, the smallest key reachable, whether that is its own.

    Equal vectors are one entry of the index, counted by their copies. Every entry
    visits the nearest cells of the grid, as many as :func:`fit` found to reach the
    target recall, and is compared there with all entries in double precision.
    Cells with many entries or visitors are cut into blocks of about ``block``
    rows that meet in pairs of blocks; a task returns sums and a forest of links.
    A pair counts for both when either visits the other's cell.

    Null, empty and zero vectors and those with null or non-finite components
    link with nothing; shorter vectors are filled up with zeros. Null keys are
    never smallest unless a component has no other. An empty table gives an
    empty result.
    """
    rows = stage(df.select(F.monotonically_increasing_id().alias("row"), col(key).alias("key"), col(vector).alias("embedding")), "vectors")
    sound = (
        (F.size("embedding") > 0)
        & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    distinct = rows.where("sound").groupBy("embedding").agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.min("key").alias("least"))
    distinct = stage(distinct, "vectors-distinct")
    n, width = distinct.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        return rows.select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"), F.lit(True).alias("kept"))
    grid, visits = fit(distinct, n, width, threshold, recall, sample, queries, most)

    def code(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = grid.distances(unit(matrix(batch.column("embedding"), width)))
            cells, visited = grid.cells(a, b), [grid.nearest(x, y, visits) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells, pa.int64()), pa.array(visited, pa.list_(pa.int64()))], names=["node", "copies", "embedding", "cell", "visits"]
            )

    coded = distinct.select("node", "copies", F.col("embedding").cast("array<double>").alias("embedding"))
    coded = stage(coded.mapInArrow(code, "node long, copies long, embedding array<double>, cell long, visits array<long>"), "vectors-coded")
    chunks = lambda name: F.ceil(F.count("*") / block).cast("int").alias(name)
    held = coded.groupBy("cell").agg(chunks("held"))
    asked = coded.select(F.explode("visits").alias("cell")).groupBy("cell").agg(chunks("asked"))
    sizes = stage(held.join(asked, "cell").withColumnRenamed("cell", "at"), "vectors-cells")
    part = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    entries = coded.join(sizes, F.col("cell") == F.col("at")).select(
        "at", part("held").alias("h"), F.explode(F.expr("sequence(0, asked - 1)")).alias("q"), F.lit(False).alias("asks"), "node", "copies", "embedding", "cell", "visits"
    )
    visitors = coded.withColumn("to", F.explode("visits")).join(sizes, F.col("to") == F.col("at")).select(
        "at", F.explode(F.expr("sequence(0, held - 1)")).alias("h"), part("asked").alias("q"), F.lit(True).alias("asks"), "node", "copies", "embedding", "cell", "visits"
    )

    def verify(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        node, copies, cell = (table.column(c).to_numpy() for c in ("node", "copies", "cell"))
        vectors = unit(matrix(table.column("embedding").combine_chunks(), width))
        visits = table.column("visits").to_pylist()
        q, e = np.flatnonzero(asks), np.flatnonzero(~asks)
        links, label = np.zeros(len(node), np.int64), np.arange(len(node))
        for at in range(0, len(q), 512):
            some = q[at : at + 512]
            x, y = np.nonzero(vectors[some] @ vectors[e].T >= threshold)
            x, y = some[x], e[y]
            other = node[x] != node[y]
            x, y = x[other], y[other]
            np.add.at(links, x, copies[y])
            back = np.array([cell[i] in visits[j] for i, j in zip(x.tolist(), y.tolist())], bool)
            np.add.at(links, y[~back], copies[x[~back]])
            label = joined(label, x, y)
        some = np.flatnonzero((links > 0) | (label != np.arange(len(node))))
        return pa.table({"a": node[some], "b": node[label[some]], "n": links[some]})

    found = entries.unionByName(visitors).groupBy("at", "h", "q").applyInArrow(verify, "a long, b long, n long")
    found = stage(found, "vectors-links")
    roots = components(found.select("a", "b"), "vectors")
    counts = found.groupBy("a").agg(F.sum("n").alias("n"))
    entry = distinct.join(counts, F.col("node") == F.col("a"), "left").drop("a")
    entry = entry.join(roots.withColumnRenamed("node", "a"), F.col("node") == F.col("a"), "left")
    entry = stage(entry.select("embedding", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "node").alias("root")), "vectors-rooted")
    least = stage(entry.groupBy("root").agg(F.min("least").alias("component")).withColumnRenamed("root", "r"), "vectors-least")
    named = entry.join(least, F.col("root") == F.col("r")).select(F.col("embedding").alias("v"), "n", "component")
    named = stage(named, "vectors-components")
    out = rows.join(named, F.col("sound") & (F.col("embedding") == F.col("v")), "left")
    component = F.when(F.col("sound"), F.col("component")).otherwise(F.col("key"))
    return out.select("key", F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component"), F.col("key").eqNullSafe(component).alias("kept"))
