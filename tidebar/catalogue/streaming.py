"""Queries of the streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.catalogue import query
from tidebar.catalogue.common import ctes, ewm_sql, rnd, rounded
from tidebar.plans import inputs as I
from tidebar.plans.zones import Order
from tidebar.session import new_path
from tidebar.streaming import streams as S

# Arrival: four files by event time; one in 97 rows of the first comes with the last.
_EDGES = ("2024-01-08", "2024-01-16", "2024-01-23")


def _arrivals(spark, sf, late: bool, twice: bool = False):
    """Events and the number of the delivery they come with; some of the first come with the last, some a second time with the next."""
    events = I.table(spark, sf, "events").select(F.col("event_type").alias("series"), "ts", "value", "event_id")
    part = F.lit(0)
    for edge in _EDGES:
        part = part + (F.col("ts") >= F.lit(f"{edge} 00:00:00").cast("timestamp_ntz")).cast("int")
    if late:
        part = F.when((part == 0) & (F.col("event_id") % 97 == 0), 3).otherwise(part)
    rows = events.withColumn("_part", part)
    if twice:
        again = rows.where((F.col("event_id") % 3 > 0) & (F.col("_part") < len(_EDGES))).withColumn("_part", F.col("_part") + F.col("event_id") % 2)
        rows = rows.unionByName(again.withColumn("_part", F.col("_part").cast("int")))
    return rows


def _deliver(spark, rows, run):
    """Each delivery is a few files in the stream's folder, after which the stream starts again where it left off."""
    path, schema = new_path(spark, "arrivals"), rows.drop("_part").schema
    for k in range(len(_EDGES) + 1):
        rows.where(F.col("_part") == k).drop("_part").repartitionByRange("ts").write.mode("append").parquet(path)
        run(spark.readStream.schema(schema).parquet(path))


@query(
    "stream_bars",
    """WITH e AS (SELECT *, time_bucket(INTERVAL '15 minutes', ts) AS bar FROM events WHERE NOT (ts < '2024-01-08' AND event_id % 97 = 0)),
       b AS (SELECT event_type AS series, bar AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
          last(value ORDER BY ts, event_id) AS close, count(*) AS volume FROM e GROUP BY 1, 2)
       SELECT b.* FROM b, (SELECT date_trunc('millisecond', max(ts)) - INTERVAL '10 minutes' AS mark FROM events) m
       WHERE ts + INTERVAL '15 minutes' <= mark""",
)
def q_stream_bars(spark, sf):
    out, progress, schema = new_path(spark, "stream-bars"), new_path(spark, "stream-bars-progress"), []

    def run(stream):
        bars = S.stream_bars(stream.withColumnRenamed("value", "price"), "15 minutes", ids=("event_id",))
        schema[:] = [bars.schema]
        S.run_available(bars, out, progress)

    _deliver(spark, _arrivals(spark, sf, late=True), run)
    return spark.read.schema(schema[0]).parquet(out)


@query(
    "stream_bars_revised",
    """SELECT event_type AS series, time_bucket(INTERVAL '15 minutes', ts) AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
        min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS volume FROM events GROUP BY 1, 2""",
)
def q_stream_bars_revised(spark, sf):
    out, progress = new_path(spark, "revised-bars"), new_path(spark, "revised-bars-progress")
    revise = lambda rows, k: S.revise_bars(rows, k, out, "15 minutes", "value", ("event_id",))
    _deliver(spark, _arrivals(spark, sf, late=True), lambda stream: S.run_batches(stream, revise, progress))
    return S.revised_bars(spark, out)


@query(
    "stream_append_dedup",
    "SELECT DISTINCT event_type AS series, ts, value, event_id FROM events",
)
def q_stream_dedup(spark, sf):
    """Copies come with the same delivery and with the next one, late rows with the last."""
    out, progress = new_path(spark, "stream-dedup"), new_path(spark, "stream-dedup-progress")
    rows = _arrivals(spark, sf, late=True, twice=True)
    _deliver(spark, rows, lambda stream: S.run_batches(stream, lambda b, k: S.append_once(b, k, out, ["event_id"]), progress))
    return S.appended(spark, out, rows.drop("_part").schema)


@query("stream_dedup_within_delay", "SELECT DISTINCT event_type AS series, ts, value, event_id FROM events")
def q_stream_dedup_within_delay(spark, sf):
    out, progress = new_path(spark, "dedup-delay"), new_path(spark, "dedup-delay-progress")
    rows = _arrivals(spark, sf, late=False)
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(2)))).drop("_copy")
    _deliver(spark, rows, lambda stream: S.run_available(S.stream_append_dedup(stream, ["event_id"]), out, progress))
    return spark.read.schema(rows.drop("_part").schema).parquet(out)


@query(
    "stream_ema_signals",
    ctes(
        recursive=True,
        ev="SELECT event_type AS series, ts, event_id, value FROM events",
        **ewm_sql("ev", {"ema_fast": ("value", 9), "ema_slow": ("value", 21)}),
    )
    + f"""SELECT n.series, n.ts, event_id, value, {rnd('ema_fast', 'ema_slow')}, (round(ema_fast, 6) > round(ema_slow, 6))::INTEGER AS signal
        FROM ew JOIN num n USING (series, rn)""",
)
def q_stream_ema(spark, sf):
    """Late rows included: the means are those of all rows in the order of time."""
    out, progress = new_path(spark, "stream-ema"), new_path(spark, "stream-ema-progress")
    order = Order(60, ties=("event_id",))
    revise = lambda rows, k: S.revise_means(rows, k, out, {"ema_fast": 9, "ema_slow": 21}, order)
    _deliver(spark, _arrivals(spark, sf, late=True), lambda stream: S.run_batches(stream, revise, progress))
    means = rounded(S.revised_means(spark, out))
    return means.withColumn("signal", (F.col("ema_fast") > F.col("ema_slow")).cast("int"))
