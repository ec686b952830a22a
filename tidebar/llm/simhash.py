"""SimHash near-duplicates by a Gray-order hierarchical index."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import col, components, partitions, whole
from tidebar.session import stage

_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
FAN = 8


def fingerprint(text: str, shingle: int) -> int:
    """The bits set in over half the XXH64 (seed 42) values of all word shingles, as a signed 64-bit integer.

    A text of fewer words has one shingle, the whole sequence; one of none has fingerprint 0.
    """
    found = text.encode("utf-8", "replace").translate(_UPPER).split()
    if not found:
        return 0
    line, n = b" ".join(found), max(1, len(found) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    values = np.array([digest(line[a:b], 42) for a, b in zip(starts, stops)], "<u8").view(np.uint8).reshape(n, 8)
    ones = [np.bincount(values[:, i], minlength=256) @ _BITS for i in range(8)]
    return int(np.packbits(2 * np.concatenate(ones) > n, bitorder="little").view("<i8")[0])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of a code in the Gray sequence; neighbours in it differ in few bits."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A forest over fingerprints in Gray order, one tree per bucket.

    FAN neighbours share a parent, which keeps the bits all of them have alike; a
    node keeps only those its parent has not. A search adds up, from the root
    down, the differing bits of the node's own pattern, and drops whole groups
    once the sum is above the radius. At a leaf the sum is the exact distance.
    """

    def __init__(self, bucket: np.ndarray, codes: np.ndarray):
        """Both sorted by bucket and then Gray rank."""
        ones, zeros, owner = codes, ~codes, bucket
        self.levels = []  # from the leaves up: first child of each node, one more at the end
        alike = [(ones, zeros)]
        while len(owner) and (owner[1:] == owner[:-1]).any():
            begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            place = np.arange(len(owner)) - np.repeat(begins, np.diff(np.r_[begins, len(owner)]))
            first = np.flatnonzero(place % FAN == 0)
            ones, zeros = np.bitwise_and.reduceat(ones, first), np.bitwise_and.reduceat(zeros, first)
            owner = owner[first]
            self.levels.append(np.r_[first, len(place)])
            alike.append((ones, zeros))
        self.roots = owner
        self.nodes = []  # per level: pattern, own mask
        for depth, (one, zero) in enumerate(alike):
            mask = one | zero
            if depth < len(self.levels):
                up = np.repeat(np.arange(len(self.levels[depth]) - 1), np.diff(self.levels[depth]))
                mask = mask & ~(alike[depth + 1][0] | alike[depth + 1][1])[up]
            self.nodes.append((one, mask))

    def search(self, bucket: np.ndarray, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) of all pairs in one bucket whose codes differ in at most ``radius`` bits."""
        query, node = np.arange(len(codes)), np.searchsorted(self.roots, bucket)
        spent = np.zeros(len(codes), np.uint8)
        for depth in range(len(self.levels), -1, -1):
            pattern, mask = self.nodes[depth]
            spent = spent + np.bitwise_count((codes[query] ^ pattern[node]) & mask[node])
            near = spent <= radius
            query, node, spent = query[near], node[near], spent[near]
            if depth:
                first = self.levels[depth - 1]
                n = first[node + 1] - first[node]
                begins = np.repeat(first[node] - np.r_[0, np.cumsum(n)[:-1]], n) if len(n) else n
                query, spent = np.repeat(query, n), np.repeat(spent, n)
                node = begins + np.arange(len(query))
        return query, node


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a[i] with b[i]: each node's points to a smaller node of its component, or to itself."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]
    return label


def _search_partition(radius: int, work: int = 1 << 22):
    """Links of a partition's buckets as a forest: at most one edge per row."""

    def search(batches):
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.Table.from_batches(tables)
        mask, value, code = (table.column(c).to_numpy().view(np.uint64) for c in ("mask", "value", "code"))
        order = np.lexsort((gray_rank(code), value, mask))
        mask, value, code = mask[order], value[order], code[order]
        bucket = np.cumsum(np.r_[False, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])])
        index, label = GrayIndex(bucket, code), np.arange(len(code))
        sizes = np.bincount(bucket)[bucket]
        upto, at = np.cumsum(sizes), 0
        while at < len(code):  # so many queries at a time that even a search without pruning is bounded
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + work)))
            query, leaf = index.search(bucket[at:to], code[at:to], radius)
            label = joined(label, query + at, leaf)
            at = to
        linked = label != np.arange(len(code))
        yield pa.RecordBatch.from_arrays(
            [pa.array(code[linked].view(np.int64)), pa.array(code[label[linked]].view(np.int64))], names=["a", "b"]
        )

    return search


def slices(mask: int, parts: int) -> list[int]:
    """The bits not in ``mask``, cut into so many masks."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [round(k * len(free) / parts) for k in range(parts + 1)]
    return [sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(codes: DataFrame, radius: int, limit: int = 1024, depth: int = 3) -> DataFrame:
    """Edges (a, b) that connect all distinct ``code`` values within ``radius`` bits; none between others.

    Codes that differ in r bits agree in one of r + 1 slices of their bits, so each
    is dealt to r + 1 buckets by (slice, its bits there). A bucket of more than
    ``limit`` codes is dealt on by slices of the bits that are still free, which
    is as exact, up to ``depth`` times. Each task indexes its buckets in Gray
    order and returns a forest of their links, not their pairs.
    """
    parts, ready = radius + 1, []
    masks = [0]
    level = codes.select("code", F.lit(0).cast("long").alias("mask"))
    for step in range(depth):
        wider = {m: [m | s for s in slices(m, parts)] for m in masks}
        masks = sorted({w for ws in wider.values() for w in ws})
        choice = F.create_map(*(x for m, ws in wider.items() for x in (F.lit(signed(m)), F.array(*(F.lit(signed(w)) for w in ws)))))
        dealt = level.select("code", F.explode(F.element_at(choice, F.col("mask")) if step else F.array(*(F.lit(signed(w)) for w in wider[0]))).alias("mask"))
        dealt = dealt.withColumn("value", F.col("code").bitwiseAND(F.col("mask")))
        if step == depth - 1:
            ready.append(dealt)
            break
        dealt = stage(dealt, "simhash-buckets")
        large = dealt.groupBy("mask", "value").count().where(F.col("count") > limit).select(F.col("mask").alias("m"), F.col("value").alias("v"))
        large = stage(large, "simhash-large")
        here = (F.col("mask") == F.col("m")) & (F.col("value") == F.col("v"))
        if large.isEmpty():
            ready.append(dealt)
            break
        ready.append(dealt.join(large, here, "left_anti"))
        level = dealt.join(large, here, "left_semi").select("code", "mask")
    found = [r.repartition(partitions(codes), "mask", "value").mapInArrow(_search_partition(radius), "a long, b long") for r in ready]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def groups(df: DataFrame, key: str, text: str, shingle: int = 3, radius: int = 3) -> DataFrame:
    """(row, key, code, root, component) per row of ``df``: its number, key, fingerprint, component and the smallest
    key in that.

    Fingerprints link at ``radius`` or fewer differing bits; only distinct ones
    are searched and joined. Null and empty texts have fingerprint 0 and link
    like others. Null keys are never smallest unless a component has no other.
    Repeated rows share a component. An empty table gives an empty result.
    """
    return _grouped(_marked(df, key, text, shingle, []), radius)


def dedup(df: DataFrame, key: str, text: str, shingle: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``df``, one of each component of :func:`groups`: that of the smallest key, of equal ones the first."""
    marked = _marked(df, key, text, shingle, df.columns)
    grouped = _grouped(marked, radius)
    best = grouped.where(F.col("key").eqNullSafe(F.col("component"))).groupBy("root").agg(F.min("row").alias("best"))
    kept = marked.join(best.select(F.col("best").alias("row")), "row", "left_semi")
    return kept.select(*(F.col("given").getField(c).alias(c) for c in df.columns))


def _marked(df: DataFrame, key: str, text: str, shingle: int, carry: list[str]) -> DataFrame:
    """Row number, key, fingerprint and the carried columns, written once."""

    @F.pandas_udf("long")
    def code(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    given = [F.struct(*(col(c) for c in carry)).alias("given")] if carry else []
    row = F.monotonically_increasing_id().alias("row")
    return stage(df.select(row, col(key).alias("key"), code(whole(text)).alias("code"), *given), "simhash")


def _grouped(marked: DataFrame, radius: int) -> DataFrame:
    distinct = stage(marked.groupBy("code").agg(F.min("key").alias("least")), "simhash-codes")
    roots = components(links(distinct.select("code"), radius), "simhash")
    rooted = distinct.join(roots, F.col("code") == F.col("node"), "left")
    rooted = stage(rooted.select("code", "least", F.coalesce("root", "code").alias("root")), "simhash-rooted")
    least = stage(rooted.groupBy("root").agg(F.min("least").alias("component")).withColumnRenamed("root", "r"), "simhash-least")
    named = rooted.join(least, F.col("root") == F.col("r"))
    named = stage(named.select(F.col("code").alias("of"), "root", "component"), "simhash-components")
    return marked.join(named, F.col("code") == F.col("of")).select("row", "key", "code", "root", "component")
