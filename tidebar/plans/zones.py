"""Ordered computations over long series, split into time zones of bounded size.

Rolling means, lags, fills and running sums need the rows of one series in
order. ``Window.partitionBy("series")`` gives each series to one task, so a
series with a third of all rows would decide the run time. Here every series is
cut into *zones* of about ``rows`` consecutive rows:

1. ``zone_map`` counts rows per (series, bucket), a bucket being a short time
   range. Where a bucket holds more rows than a zone should (a burst), it is
   split again and again: by time, and rows of one instant by the first of the
   columns that order them, if that is an integer. The running count gives each
   bucket the position of its first row. The map has one row per bucket, never
   one per input row; of a long map the running count is taken in two levels.
2. ``enter`` joins the map, which sends every row to its own zone (``_core``)
   and copies the buckets within ``before``/``after`` positions of another zone
   to that zone as context. One shuffle on (series, _zone) follows, shared by
   all windows an operator needs. The map is written to the scratch folder
   first: it is then computed once, not once per branch of the plan, and Spark
   knows its size when it plans the join. A small map is broadcast and the rows
   are shuffled only by zone; for a large one they are shuffled once more, on
   (series, bucket), whose groups are small by construction.
3. ``leave`` keeps the core rows, each exactly once.

A row without a timestamp or key has no place in an order. It comes through,
alone in a zone of its own, and what was added to it between the two is NULL.

What reaches further than any fixed context (fills, running sums, exponential
means) is solved in two levels: inside the zone with a window, between zones on
a table with one row per zone, joined back on (series, _zone).

Results do not depend on ``rows``; tests run every query with tiny zones too.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.functions.scalars import epoch_micros, epoch_seconds
from tidebar.session import stage

ZONE_ROWS = 4096
ZONE_ROWS_CONF = "spark.tidebar.zoneRows"
BUCKETS_PER_ZONE = 16
LONG_MAP = 1_000_000
LONG_MAP_CONF = "spark.tidebar.longMap"
STRETCH = 1024
SMALL_INPUT = 256 << 20  # bytes
HELPERS = ("_zone", "_core", "_pos", "_n")


@dataclass(frozen=True)
class Order:
    """How a frame is ordered: per ``keys``, by ``ts`` and then ``ties``.

    ``step`` is the usual distance of neighbouring rows in seconds. It sets the
    width of a bucket, hence how evenly the zones come out; not the result.
    """

    step: float = 3600
    keys: tuple[str, ...] = ("series",)
    ts: str = "ts"
    ties: tuple[str, ...] = ()
    rows: int | None = None

    def with_rows(self, rows: int) -> "Order":
        return replace(self, rows=rows)


HOURLY = Order(3600)
QUARTER_HOURLY = Order(900)
DAILY = Order(86400)


def zone_rows(spark: SparkSession, order: Order) -> int:
    if order.rows:
        return order.rows
    return int(spark.conf.get(ZONE_ROWS_CONF, str(ZONE_ROWS)))


def fit(df: DataFrame, order: Order, most_zones: int = 1 << 18) -> Order:
    """``order`` with step and zone size measured on ``df``, by one aggregate over keys and time.

    For frames that are not on a regular grid, such as ticks, and for series so
    long that the zone table (one row per zone, handled per keys) would itself
    grow large: the longest series gets at most about ``most_zones`` zones.
    """
    span = epoch_seconds(F.max(order.ts)) - epoch_seconds(F.min(order.ts))
    per_key = df.groupBy(*order.keys).agg(F.count(F.lit(1)).alias("n"), span.alias("span"))
    top = per_key.agg(F.max("n").alias("n"), F.max(F.col("n") / (F.col("span") + 1)).alias("density")).first()
    if not top["n"]:
        return order
    rows = order.rows
    if rows is None and top["n"] > most_zones * zone_rows(df.sparkSession, order):
        rows = -(-top["n"] // most_zones)
    return replace(order, step=max(1.0 / top["density"], 1e-6), rows=rows)


def _width(order: Order, rows: int) -> int:
    """Microseconds of a bucket."""
    return max(1, round(order.step * 1e6 * max(1, rows // BUCKETS_PER_ZONE)))


def _bucket(order: Order, rows: int) -> Column:
    """Start of the time range of a row; plain integer arithmetic on the timestamp."""
    # a window over a missing time would drop the row
    ts = F.coalesce(F.col(order.ts), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))
    return F.window(ts, f"{_width(order, rows)} microseconds").start.alias("_bucket")


def _has_place(order: Order) -> Column:
    placed = F.col(order.ts).isNotNull()
    for k in order.keys:
        placed = placed & F.col(k).isNotNull()
    return placed


@dataclass(frozen=True)
class _Counted:
    """Rows per bucket as a stored table, and the splits that lead from a time range to its parts."""

    table: DataFrame  # keys, _bucket, _part (the path of parts), _c
    splits: tuple[DataFrame, ...]  # keys, _bucket, _part, how to split it
    buckets: int


def _tie(df: DataFrame, order: Order) -> Column:
    """What splits rows of one instant: the first tie if it is an integer."""
    if order.ties and isinstance(df.schema[order.ties[0]].dataType, T.IntegralType):
        return F.col(order.ties[0]).cast("long")
    return F.lit(0).cast("long")


def _parted(df: DataFrame, order: Order, splits: tuple[DataFrame, ...]) -> DataFrame:
    """Rows with ``_bucket`` and ``_part``: the part of the time range at each level of splits, empty where there was none."""
    df = df.withColumn("_part", F.array().cast("array<bigint>"))
    names = [*order.keys, "_bucket", "_part"]
    for split in splits:
        split = split.select(*(F.col(n).alias(f"_s{n}") for n in names), "_by", "_low", "_span", "_parts")
        match = F.lit(True)
        for n in names:
            match = match & (F.col(n) == F.col(f"_s{n}"))
        value = F.when(F.col("_by") == "time", epoch_micros(order.ts)).otherwise(F.coalesce(_tie(df, order), F.col("_low")))
        # in double precision neighbours may share a part, but never change places
        at = F.floor((value - F.col("_low")).cast("double") / F.col("_span") * F.col("_parts"))
        part = F.when(F.col("_by").isNull(), F.col("_part")).otherwise(F.concat("_part", F.array(F.least(at, F.col("_parts") - 1))))
        df = df.join(split, match, "left").withColumn("_part", part).drop(*(f"_s{n}" for n in names), "_by", "_low", "_span", "_parts")
    return df


def _counted(df: DataFrame, order: Order, rows: int) -> _Counted:
    """Count rows per bucket; split buckets of more than ``rows`` rows until none is left that can be split.

    The first pass costs one aggregate over the rows; each further one reads the
    rows of heavy buckets only, and there is one only where a burst calls for it.
    """
    placed = df.where(_has_place(order)).withColumn("_bucket", _bucket(order, rows))
    names, value = [*order.keys, "_bucket", "_part"], _tie(df, order)
    times = [F.min(epoch_micros(order.ts)).alias("_t0"), F.max(epoch_micros(order.ts)).alias("_t1")]
    ends = [F.count(F.lit(1)).alias("_c"), *times, F.min(value).alias("_v0"), F.max(value).alias("_v1")]
    can = F.coalesce((F.col("_t0") < F.col("_t1")) | (F.col("_v0") < F.col("_v1")), F.lit(False))

    def count(part: DataFrame, first: bool) -> tuple[DataFrame, int, bool]:
        seen = Observation()
        plain = F.array().cast("array<bigint>").alias("_part")
        counts = part.groupBy(*order.keys, "_bucket").agg(F.count(F.lit(1)).alias("_c")).withColumn("_part", plain) if first else part.groupBy(*names).agg(*ends)
        heavy = F.col("_c") > rows if first else (F.col("_c") > rows) & can
        table = stage(counts.observe(seen, F.count(F.lit(1)).alias("n"), F.max(heavy).alias("heavy")), "buckets")
        return table, seen.get["n"], bool(seen.get["heavy"])

    table, buckets, heavy = count(placed, True)
    light, splits = table, []
    if heavy:  # the ends of the heavy ones are needed too
        crowded = table.where(F.col("_c") > rows)
        light = table.where(F.col("_c") <= rows)
        named = [*order.keys, "_bucket"]
        table = stage(_parted(placed, order, ()).join(crowded.select(*named), named, "left_semi").groupBy(*names).agg(*ends), "buckets")
    while heavy:
        crowded = table.where((F.col("_c") > rows) & can)
        light = light.select(*names, "_c").unionByName(table.where(~((F.col("_c") > rows) & can)).select(*names, "_c"))
        by_time = F.col("_t0") < F.col("_t1")
        low = F.when(by_time, F.col("_t0")).otherwise(F.col("_v0"))
        high = F.when(by_time, F.col("_t1")).otherwise(F.col("_v1"))
        parts = F.least(F.lit(4096), F.greatest(F.lit(2), F.ceil(F.col("_c") / rows) * BUCKETS_PER_ZONE)).cast("long")
        splits.append(
            stage(
                crowded.select(
                    *names, F.when(by_time, "time").otherwise("tie").alias("_by"), low.alias("_low"),
                    (high.cast("double") - low.cast("double") + 1).alias("_span"), parts.alias("_parts"),
                ),
                "splits",
            )
        )
        below = placed.join(crowded.select(*order.keys, "_bucket").distinct(), [*order.keys, "_bucket"], "left_semi")
        below = _parted(below, order, tuple(splits)).where(F.size("_part") == len(splits))
        table, more, heavy = count(below, False)
        buckets += more
    if splits:
        light = stage(light.unionByName(table.select(*names, "_c")), "buckets")
    return _Counted(light, tuple(splits), buckets)


def _running(counts: DataFrame, order: Order, width: int, two_levels: bool) -> DataFrame:
    """Adds ``_off`` (rows before the bucket), ``_n`` and ``_cmax`` (of the keys) to the counts.

    Short maps take one window per keys. Long ones are cut into stretches of
    time: a window in each, and one over the stretches, a few thousandths of the map.
    """
    at = [c for c in ("_bucket", "_part") if c in counts.columns]
    whole = Window.partitionBy(*order.keys)
    if not two_levels:
        run = whole.orderBy(*at).rowsBetween(Window.unboundedPreceding, 0)
        total = {"_off": F.sum("_c").over(run) - F.col("_c"), "_n": F.sum("_c").over(whole), "_cmax": F.max("_c").over(whole)}
        return counts.withColumns(total)
    counts = counts.withColumn("_stretch", F.floor(epoch_micros("_bucket") / (width * STRETCH)))
    inside = Window.partitionBy(*order.keys, "_stretch").orderBy(*at).rowsBetween(Window.unboundedPreceding, 0)
    local = counts.withColumn("_in", F.sum("_c").over(inside) - F.col("_c"))
    sums = counts.groupBy(*order.keys, "_stretch").agg(F.sum("_c").alias("_sc"), F.max("_c").alias("_sm"))
    chain = whole.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumns({"_before": F.sum("_sc").over(chain) - F.col("_sc"), "_n": F.sum("_sc").over(whole), "_cmax": F.max("_sm").over(whole)})
    out = local.join(sums.drop("_sc", "_sm"), [*order.keys, "_stretch"]).withColumn("_off", F.col("_in") + F.col("_before"))
    return out.drop("_in", "_before", "_stretch")


def zone_map(counted: _Counted, order: Order, rows: int, before: int = 0, after: int = 0, seen: Observation | None = None) -> DataFrame:
    """One row per (keys, bucket, zone the bucket serves), with the position of its first row.

    ``_core`` marks the bucket's own zone; in the others its rows are context.
    ``seen`` gets whether a bucket is ``heavy``, once the map is written.
    """
    long = int(counted.table.sparkSession.conf.get(LONG_MAP_CONF, str(LONG_MAP)))
    m = _running(counted.table, order, _width(order, rows), counted.buckets > long)
    if seen is not None:
        m = m.observe(seen, F.max(F.col("_c") > rows).alias("heavy"))
    names = [*order.keys, "_bucket", "_part"] if counted.splits else [*order.keys, "_bucket"]
    home = F.floor(F.col("_off") / rows)
    if not (before or after):
        return m.select(*names, "_off", "_n", home.alias("_zone"), F.lit(True).alias("_core"))
    # zone z starts at or after row z*rows and ends before (z+1)*rows + largest bucket
    low = F.greatest(F.lit(0), F.floor((F.col("_off") + 1 - F.col("_cmax") - after) / rows))
    low = F.least(home, low) if after else home
    high = F.floor((F.col("_off") + F.col("_c") + before - 1) / rows)
    high = F.greatest(home, F.least(high, F.floor((F.col("_n") - 1) / rows))) if before else home
    m = m.withColumns({"_home": home, "_zone": F.explode(F.sequence(low, high))})
    return m.select(*names, "_off", "_n", "_zone", (F.col("_zone") == F.col("_home")).alias("_core"))


def window(order: Order) -> WindowSpec:
    return Window.partitionBy(*order.keys, "_zone").orderBy(order.ts, *order.ties)


def stored_map(df: DataFrame, order: Order, rows: int, before: int = 0, after: int = 0) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """The map as a stored table, and the splits its buckets went through.

    From an input that Spark knows to be small the map is made in one go, and
    made again with splits if a bucket proves heavy; from any other the buckets
    are counted and stored first.
    """
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= SMALL_INPUT:
        counts = df.where(_has_place(order)).groupBy(*order.keys, _bucket(order, rows)).agg(F.count(F.lit(1)).alias("_c"))
        seen = Observation()
        m = stage(zone_map(_Counted(counts, (), 0), order, rows, before, after, seen), "zones")
        if not seen.get["heavy"]:
            return m, ()
    counted = _counted(df, order, rows)
    return stage(zone_map(counted, order, rows, before, after), "zones"), counted.splits


def enter(df: DataFrame, order: Order, before: int = 0, after: int = 0) -> DataFrame:
    """Rows with ``_zone``, ``_core``, ``_pos`` (0-based, per keys) and ``_n`` (rows per keys).

    A row without a timestamp or without a key has neither ``_pos`` nor ``_n`` and is the only one of its zone.
    """
    rows = zone_rows(df.sparkSession, order)
    m, splits = stored_map(df, order, rows, before, after)
    placed = _has_place(order)
    # rows without a place get a time range that the map does not have, so that no task gets all of them
    z = df.withColumn("_alone", F.when(~placed, F.monotonically_increasing_id()))
    z = z.withColumn("_bucket", F.when(placed, _bucket(order, rows)).otherwise(_nowhere(F.col("_alone"))))
    if splits:
        z = _parted(z, order, splits)
    z = z.join(m, [*order.keys, "_bucket", *(["_part"] if splits else [])], "left")
    given = {"given": df.columns}
    z = z.withColumns({"_zone": F.coalesce("_zone", -1 - F.col("_alone")), "_core": F.coalesce("_core", F.lit(True))})
    z = z.withColumn("_core", F.col("_core").alias("_core", metadata=given))
    w = window(order)
    start = F.first("_off").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return z.withColumn("_pos", start + F.row_number().over(w) - 1).drop("_bucket", "_part", "_off", "_alone")


def _nowhere(number: Column) -> Column:
    """A moment in the year 1 for each number, spread over it."""
    return F.lit("0001-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.pmod(F.xxhash64(number), F.lit(30_000_000)).cast("decimal(18,6)"))


def leave(z: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Core rows only, without the helper columns (``keep`` renames none, keeps some); what was added to a row without a place is NULL."""
    given = (z.schema["_core"].metadata or {}).get("given", z.columns)
    placed = F.col("_pos").isNotNull()
    out = [c for c in z.columns if c not in HELPERS or c in keep]
    columns = [F.col(c) if c in given or c in HELPERS else F.when(placed, F.col(c)).alias(c) for c in out]
    return z.where("_core").select(*columns)


def over(
    df: DataFrame,
    order: Order,
    before: int = 0,
    after: int = 0,
    **columns,
) -> DataFrame:
    """Add window columns that reach at most ``before``/``after`` rows away.

    Each value is a function of the window, e.g. ``lambda w: F.lag("x").over(w)``.
    """
    z = enter(df, order, before, after)
    w = window(order)
    z = z.withColumns({name: make(w) for name, make in columns.items()})
    return leave(z)


class Carry:
    """Values that need rows of any distance, all solved with one zone table and one join.

    Each value has a local part (a window in the zone), a tail per zone, a carry
    (a window over the tails of other zones) and a final expression. Add all
    values an operator needs, then call ``apply`` once: the rows are then read
    twice, not once more per value. ``cell`` limits the local runs to that many
    positions, for values that would overflow over a whole zone.
    """

    def __init__(self, z: DataFrame, order: Order, cell: int | None = None):
        self.z = z if cell is None else z.withColumn("_cell", F.floor(F.col("_pos") / cell))
        self.order = order
        self.cell = cell
        self.group = [*order.keys, "_zone"] + (["_cell"] if cell else [])
        self.zone = window(order)
        self.run = Window.partitionBy(*self.group).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
        self.chain = Window.partitionBy(*order.keys).orderBy(*self.group[len(order.keys):])
        self.local: dict[str, Column] = {}
        self.tails: dict[str, Column] = {}
        self.carries: dict[str, Column] = {}
        self.final: dict[str, Column] = {}

    def add(self, out: str, local: Column, tail: Column, carry: Column, final: Column) -> None:
        """``tail`` may use ``_l_<out>``, ``carry`` ``_t_<out>``, ``final`` both ``_l_`` and ``_c_<out>``."""
        self.local[f"_l_{out}"] = local
        self.tails[f"_t_{out}"] = tail
        self.carries[f"_c_{out}"] = carry
        self.final[out] = final

    def fill_forward(self, out: str, source: str | Column) -> None:
        """Last non-missing value at or before the row."""
        c = F.col(source) if isinstance(source, str) else source
        self.add(
            out,
            F.last(c, ignorenulls=True).over(self.zone.rowsBetween(Window.unboundedPreceding, 0)),
            F.max_by(c, F.when(c.isNotNull(), F.col("_pos"))),
            F.last(f"_t_{out}", ignorenulls=True).over(self.chain.rowsBetween(Window.unboundedPreceding, -1)),
            F.coalesce(f"_l_{out}", f"_c_{out}"),
        )

    def fill_backward(self, out: str, source: str | Column) -> None:
        """Next non-missing value at or after the row.

        Runs over descending positions: a frame that ends at the last row would
        be evaluated anew for every row.
        """
        c = F.col(source) if isinstance(source, str) else source
        down = Window.partitionBy(*self.order.keys, "_zone").orderBy(F.col("_pos").desc())
        links = [F.col(g).desc() for g in self.group[len(self.order.keys):]]
        later = Window.partitionBy(*self.order.keys).orderBy(*links)
        self.add(
            out,
            F.last(c, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0)),
            F.min_by(c, F.when(c.isNotNull(), F.col("_pos"))),
            F.last(f"_t_{out}", ignorenulls=True).over(later.rowsBetween(Window.unboundedPreceding, -1)),
            F.coalesce(f"_l_{out}", f"_c_{out}"),
        )

    def running_sum(self, out: str, value: Column) -> None:
        """Sum over all rows of the keys up to and including the row."""
        value = F.when(F.col("_core"), value)
        self.add(
            out,
            F.sum(value).over(self.run),
            F.sum(value),
            F.sum(f"_t_{out}").over(self.chain.rowsBetween(Window.unboundedPreceding, -1)),
            F.col(f"_l_{out}") + F.coalesce(F.col(f"_c_{out}"), F.lit(0)),
        )

    def apply(self) -> DataFrame:
        z = self.z.withColumns(self.local)
        tails = z.where("_core AND _pos IS NOT NULL").groupBy(*self.group).agg(
            F.min("_pos").alias("_start"),
            (F.max("_pos") + 1).alias("_end"),
            *[c.alias(n) for n, c in self.tails.items()],
        )
        carries = tails.select(
            *[F.col(g).alias(f"_r{g}") for g in self.group], "_start", *[c.alias(n) for n, c in self.carries.items()]
        )
        # The equality is on keys and zone alone, by which the rows are partitioned already; the
        # cell, a few per zone, is matched as a range so that it does not call for another shuffle.
        match = F.lit(True)
        for g in [*self.order.keys, "_zone"]:
            match = match & (F.col(g) == F.col(f"_r{g}"))
        if self.cell:
            match = match & (F.col("_cell") >= F.col("_r_cell")) & (F.col("_cell") <= F.col("_r_cell"))
        z = z.join(carries, match, "left").withColumns(self.final)
        return z.drop("_cell", "_start", *[f"_r{g}" for g in self.group], *self.local, *self.carries)


def fill_forward(z: DataFrame, order: Order, columns: dict[str, str]) -> DataFrame:
    """``out -> source`` on a zoned frame, see ``Carry``."""
    carry = Carry(z, order)
    for out, source in columns.items():
        carry.fill_forward(out, source)
    return carry.apply()


def fill_backward(z: DataFrame, order: Order, columns: dict[str, str]) -> DataFrame:
    """``out -> source`` on a zoned frame, see ``Carry``."""
    carry = Carry(z, order)
    for out, source in columns.items():
        carry.fill_backward(out, source)
    return carry.apply()


def running_sum(z: DataFrame, order: Order, columns: dict[str, Column]) -> DataFrame:
    """``out -> expression`` on a zoned frame, see ``Carry``."""
    carry = Carry(z, order)
    for out, value in columns.items():
        carry.running_sum(out, value)
    return carry.apply()
