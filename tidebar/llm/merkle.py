"""Merkle manifest of a table: one tree per part and one over the parts, levels built by slot pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import col, running_sums
from tidebar.session import stage


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(columns: list[Column]) -> Column:
    """Digest of a row: each value as ``-`` if null, else its length in UTF-8 bytes, ``:`` and the value."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return digest(F.concat(*parts))


def _height(n: Column, fanout: int) -> Column:
    """Levels above ``n`` leaves until one node remains: the number of powers of ``fanout`` below n."""
    powers, p = [], 1
    while p < 1 << 62:
        powers.append(p)
        p *= fanout
    return F.size(F.filter(F.array(*(F.lit(p).cast("long") for p in powers)), lambda p: p < n))


class Tree:
    """Trees over ``nodes`` (tree, at: long, height: int, h: string), ``at`` counting a tree's leaves from 0 without gaps.

    A pass handles ``levels`` levels: it spreads the nodes of one ancestor,
    ``fanout ** levels`` at most, into slot columns by conditional aggregates and
    hashes concatenations of neighbouring slots; the last run of a level may be
    shorter, down to one node. Levels above a tree's height hand its root on.
    Each pass shuffles 1/slots of the rows of the one before, dealt by (tree,
    place), so one tree with a third of all rows is spread like many small ones.
    """

    def __init__(self, nodes: DataFrame, fanout: int, name: str, slots: int = 16):
        self.fanout, self.levels = fanout, 1
        while fanout ** (self.levels + 1) <= slots:
            self.levels += 1
        self.slots = fanout**self.levels
        self.passes: list[DataFrame] = []
        highest = nodes.agg(F.max("height")).first()[0] or 0
        for base in range(0, max(highest, 1), self.levels):
            pivot = stage(self._pivot(nodes, base), name)
            self.passes.append(pivot)
            nodes = pivot.select("tree", F.col("up").alias("at"), "height", F.element_at(f"n{self.levels}", 1).alias("h"))
        #: (tree, h)
        self.roots = nodes.select("tree", "h")

    def _pivot(self, nodes: DataFrame, base: int) -> DataFrame:
        """(tree, up, height, n0 .. n<levels>): the digests of each level under one ancestor, in order."""
        slot = F.pmod("at", F.lit(self.slots))
        spread = [F.max(F.when(slot == i, F.col("h"))).alias(f"s{i}") for i in range(self.slots)]
        up = F.floor(F.col("at") / self.slots).cast("long").alias("up")
        out = nodes.groupBy("tree", up, "height").agg(*spread).withColumn("n0", F.array(*(f"s{i}" for i in range(self.slots))))
        for level in range(1, self.levels + 1):
            below = F.col(f"n{level - 1}")
            runs = [F.slice(below, i * self.fanout + 1, self.fanout) for i in range(self.slots // self.fanout**level)]
            # concat_ws leaves out the slots of a short run
            made = F.array(*(F.when(r[0].isNotNull(), digest(F.concat_ws("", r))) for r in runs))
            out = out.withColumn(f"n{level}", F.when(F.col("height") >= base + level, made).otherwise(F.slice(below, 1, len(runs))))
        return out.drop(*(f"s{i}" for i in range(self.slots)))

    def _steps(self, base: int) -> Column:
        """Per level of a pass the siblings of the node above slot ``slot``: (left, right), each concatenated."""
        steps = []
        for level in range(self.levels):
            place = F.floor(F.col("slot") / self.fanout**level).cast("int")
            own = F.pmod(place, F.lit(self.fanout))
            run = F.slice(F.col(f"n{level}"), place - own + 1, self.fanout)
            left, right = F.slice(run, F.lit(1), own), F.slice(run, own + 2, self.fanout)
            steps.append(F.struct(F.concat_ws("", left).alias("left"), F.concat_ws("", right).alias("right")))
        here = F.greatest(F.lit(0), F.least(F.lit(self.levels), F.col("height") - base))
        return F.slice(F.array(*steps), F.lit(1), here)

    def paths(self, leaves: DataFrame, above: DataFrame | None = None) -> DataFrame:
        """``leaves`` (tree, at, others) with ``path``: an array of (left, right) from the leaf's level to its root's.

        ``above`` (tree, path) is what continues a tree's path beyond its root.
        Passes are joined from the top down; a path is never in a shuffle but
        once per ancestor.
        """
        top = self.passes[-1].select("tree", F.lit(0).cast("long").alias("at"))
        none = F.array().cast("array<struct<left:string,right:string>>")
        held = top.withColumn("path", none) if above is None else top.join(above, "tree")
        for k in range(len(self.passes) - 1, -1, -1):
            pivot = self.passes[k].join(held.select("tree", F.col("at").alias("up"), F.col("path").alias("rest")), ["tree", "up"])
            if k:  # its nodes are the ancestors of the pass below
                size = F.size(F.filter("n0", lambda h: h.isNotNull()))
                low = pivot.withColumn("slot", F.explode(F.sequence(F.lit(0), size - 1)))
                held = low.select("tree", (F.col("up") * self.slots + F.col("slot")).alias("at"), F.concat(self._steps(k * self.levels), "rest").alias("path"))
            else:
                up = F.floor(F.col("at") / self.slots).cast("long")
                slotted = leaves.withColumn("up", up).withColumn("slot", F.pmod("at", F.lit(self.slots)).cast("int"))
                low = slotted.join(pivot, ["tree", "up"])
                held = low.select(*(col(c) for c in leaves.columns), F.concat(self._steps(0), "rest").alias("path"))
        return held


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, start, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def manifest(df: DataFrame, part: str, key: str, columns: list[str], fanout: int = 2, keep: list[str] | None = None) -> DataFrame:
    """Adds ``leaf``, ``subroot``, ``root`` and ``path`` to every row: (left, right) siblings from the leaf up.

    A leaf is the digest of ``columns``. The leaves of a ``part``, ascending by
    ``key``, are hashed in runs of ``fanout`` until one node remains, its subroot;
    the subroots, ascending by part in UTF-8 byte order with null first, likewise
    to the root. A path proves its row: :func:`fold` of the leaf gives the root.

    Null keys stand first in their part; equal keys stand by leaf, so repeated
    rows have equal leaves and the root does not depend on the order of the
    input. A lone leaf is its part's subroot, a lone subroot the root; both have
    no siblings there. An empty table gives an empty result. The columns of
    ``keep`` stay (default: all); those named ``leaf``, ``subroot``, ``root`` or
    ``path`` are replaced. Only they, the part, key and leaf are shuffled.
    """
    added = ("leaf", "subroot", "root", "path")
    kept = [c for c in (df.columns if keep is None else keep) if c not in added]
    row = F.struct(*(col(c) for c in kept)).alias("row")
    given = df.select(row, col(part).alias("part"), col(key).alias("key"), leaf([col(c) for c in columns]).alias("leaf"), F.lit(1).alias("place"))
    order = [F.col("part").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf")]
    ran = running_sums(given, order, ["place"], "merkle-leaves")
    parts = ran.groupBy("part").agg(F.min("place_to").alias("first"), F.count("*").alias("n")).withColumn("one", F.lit(1))
    # one row per part
    parts = running_sums(parts, [F.col("part").asc_nulls_first()], ["one"], "merkle-parts")
    parts = parts.select(F.col("part").alias("of"), "first", (F.col("one_to") - 1).alias("tree"), _height(F.col("n"), fanout).alias("height"))
    placed = ran.join(parts, F.col("part").eqNullSafe(F.col("of")))
    placed = stage(placed.select("row", "leaf", "tree", (F.col("place_to") - F.col("first")).alias("at"), "height"), "merkle-placed")

    low = Tree(placed.select("tree", "at", "height", F.col("leaf").alias("h")), fanout, "merkle-low")
    n_parts = parts.count()
    subroots = low.roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), _height(F.lit(n_parts), fanout).alias("height"), "h")
    high = Tree(subroots, fanout, "merkle-high")
    root = next((r["h"] for r in high.roots.collect()), None)  # one row at most
    above = high.paths(subroots.select("tree", "at", F.col("h").alias("subroot")))
    above = stage(above.select(F.col("at").alias("tree"), "subroot", "path"), "merkle-above")
    out = low.paths(placed.drop("height"), above.select("tree", "path"))
    out = out.join(above.select("tree", "subroot"), "tree")
    return out.select(*(F.col("row").getField(c).alias(c) for c in kept), "leaf", "subroot", F.lit(root).cast("string").alias("root"), "path")
