"""Secret scans: spans of credentials, and weak candidates linked by what stands near them."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.llm.common import col, whole
from tidebar.session import stage

VALUE = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Kind, pattern, least characters of group 2 in assignments, part of a credential
BASE = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))" + VALUE, 6, "secret"),
    ("access", r"AKIA[A-Z0-9]{16,}", 20, "identifier"),
    ("hex", r"[0-9a-f]{24,}", 24, "secret"),
)
#: Reported only with another part of a credential near by.
WEAK = (
    ("identifier", r"\b((?i:client_?id|account|user_?name|user|login))" + VALUE, 3, "identifier"),
    ("key", r"\b((?i:pass|pwd|auth|credential|private_?key|key))" + VALUE, 6, "secret"),
    ("blob", r"(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{32,}={0,2}", 32, "secret"),
    ("endpoint", r"\b[a-z][a-z0-9+.-]*://[^\x00-\x20\x22'<>]+", 10, "endpoint"),
)
KINDS = [k for k, *_ in (*BASE, *WEAK)]


def _pieces(pattern: str, least: int) -> Column:
    """Per match: its place, the length of the text before it since the last one, its length, whether it counts."""
    text = F.col("_text")
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def piece(x: Column, i: Column) -> Column:
        long_enough = F.length(F.regexp_extract(x["m"], pattern, 2)) >= least if pattern.endswith(VALUE) else F.lit(True)
        return F.struct(
            i.alias("i"),
            F.length(x["gap"]).alias("gap"),
            F.coalesce(F.length(x["m"]), F.lit(0)).alias("len"),
            (x["m"].isNotNull() & long_enough).alias("counts"),
        )

    return F.when(text.rlike(pattern), F.transform(zipped, piece))


def _tag(kind: int):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("x"))


def _scan() -> list[Column]:
    return [_pieces(p, n).alias(f"_{k}") for k, p, n, _ in (*BASE, *WEAK)]


def find(df: DataFrame, key: list[str], text: str, reach: int = 300) -> DataFrame:
    """(row, key columns, spans) per row; spans: array of (start, end, kind), code points, end exclusive, sorted by
    start and then kind.

    Base kinds are always reported. Weak ones (identifiers, keys, high-entropy
    blobs, endpoints) are reported when a part of another sort, weak or not,
    lies in the same scope: no more than ``reach`` code points between the two.
    Weak parts and all parts meet in an equi-join on (row, block of ``reach``
    code points), so a text with very many parts spreads over its blocks.

    Positions come from the lengths of the pieces between matches, summed by a
    window per row and kind. Null and empty texts have no spans; equal texts and
    repeated rows are scanned one by one. An empty table gives an empty result.
    """
    read = df.select(F.monotonically_increasing_id().alias("row"), *(col(k) for k in key), whole(text).alias("_text"))
    found = stage(read.select("row", *key, *_scan()), "secrets")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    out = found.join(_reported(found, reach), F.col("row") == F.col("of"), "left")
    return out.select("row", *key, F.coalesce("spans", none).alias("spans"))


def _reported(found: DataFrame, reach: int) -> DataFrame:
    """(of, spans) of the rows of a scanned table that have any."""
    tagged = [F.transform(F.col(f"_{k}"), _tag(n)) for n, k in enumerate(KINDS)]
    empty = F.array().cast("array<struct<kind:int,x:struct<i:int,gap:int,len:int,counts:boolean>>>")
    rows = found.select("row", F.explode(F.concat(*(F.coalesce(t, empty) for t in tagged))).alias("p")).select("row", "p.kind", "p.x.*")
    so_far = W.partitionBy("row", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    ended = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(so_far))
    spans = ended.where("counts").select("row", "kind", (F.col("end") - F.col("len")).alias("start"), "end")
    part = F.element_at(F.array(*(F.lit(p) for *_, p in (*BASE, *WEAK))), F.col("kind") + 1)
    spans = stage(spans.withColumn("part", part), "secret-spans")

    block = lambda place, shift=0: F.floor(F.col(place) / reach) + shift
    weak = spans.where(F.col("kind") >= len(BASE)).withColumn("block", F.explode(F.sequence(block("start", -1), block("end", 1))))
    near = spans.select(*(F.col(c).alias(f"n_{c}") for c in ("row", "start", "end", "part")))
    near = near.withColumn("n_block", F.explode(F.sequence(block("n_start"), block("n_end"))))
    gap = F.greatest("start", "n_start") - F.least("end", "n_end")
    linked = weak.join(
        near,
        (F.col("row") == F.col("n_row")) & (F.col("block") == F.col("n_block")) & (F.col("part") != F.col("n_part")) & (gap <= reach),
        "left_semi",
    )
    said = spans.where(F.col("kind") < len(BASE)).drop("part").unionByName(linked.drop("block", "part").distinct())
    lists = said.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    return lists.select(F.col("row").alias("of"), "spans")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def base(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] < len(BASE))


def mask(df: DataFrame, text: str, reach: int = 300, by: str = "[secret]") -> DataFrame:
    """All rows of ``df``, every reported span of ``text`` replaced by ``by``; spans that overlap or touch, by one.

    ``df`` is written once with row numbers and matches. A null text stays null.
    Texts without any match stay where they are, only the others meet their spans in a join.
    """
    read = df.select(F.struct(*(col(c) for c in df.columns)).alias("given"), F.monotonically_increasing_id().alias("row"), whole(text).alias("_text"))
    scanned = read.select("given", "row", *_scan())
    matched = functools.reduce(operator.or_, (F.col(f"_{k}").isNotNull() for k in KINDS))
    inner = stage(scanned.withColumn("matched", matched), "secret-rows")
    spans = _reported(inner.where("matched"), reach)
    # each span stands for the text from where all before it ended up to its own start
    parts = spans.select("of", F.posexplode("spans").alias("i", "s")).select("of", "i", "s.start", "s.end")
    before = W.partitionBy("of").orderBy("i")
    past = F.coalesce(F.max("end").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))
    cuts = parts.withColumn("past", past).where(F.col("start") > F.col("past"))
    ends = parts.withColumn("upto", F.max("end").over(before.rowsBetween(W.unboundedPreceding, 0)))
    runs = cuts.select("of", "i", "start", F.greatest("past", F.lit(0)).alias("past"))
    last = ends.groupBy("of").agg(F.max("upto").alias("last"))
    pieces = runs.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("i", "start", "past"))).alias("cuts"))
    pieces = pieces.join(last, "of")
    given = F.col("given")
    out = inner.where("matched").join(pieces, F.col("row") == F.col("of"), "left").withColumn("_t", given.getField(text))
    shown = F.expr(
        "concat(array_join(transform(cuts, c -> substring(_t, cast(c.past + 1 AS int), cast(c.start - c.past AS int))), by), by, "
        "substring(_t, cast(last + 1 AS int)))"
    )
    out = out.withColumn("by", F.lit(by)).withColumn("_new", F.when(F.col("cuts").isNull(), F.col("_t")).otherwise(shown))
    masked = out.select(*(F.col("_new").alias(c) if c == text else given.getField(c).alias(c) for c in df.columns))
    return inner.where("NOT matched").select(*(given.getField(c).alias(c) for c in df.columns)).union(masked)
