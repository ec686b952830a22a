"""Column helpers shared by the operators. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_seconds(ts: str | Column) -> Column:
    """Seconds since 1970 from the calendar fields.

    Built from date and clock fields, so a zone-less timestamp is not routed
    through the session time zone (whose summer-time jumps are not monotone).
    """
    t = col(ts)
    clock = F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    return F.unix_date(t.cast("date")).cast("long") * 86400 + clock


def epoch_micros(ts: str | Column) -> Column:
    t = col(ts)
    clock = (F.hour(t) * 3600 + F.minute(t) * 60).cast("long") * 1_000_000
    seconds = (F.date_part(F.lit("SECOND"), t) * 1_000_000).cast("long")
    return F.unix_date(t.cast("date")).cast("long") * 86_400_000_000 + clock + seconds


def event_time(ts: str | Column) -> Column:
    """A zone-less timestamp as an instant, its clock read as UTC; watermarks need an instant."""
    return F.timestamp_micros(epoch_micros(ts))


def wall_clock(at: str | Column) -> Column:
    """Inverse of ``event_time``."""
    micros = F.unix_micros(col(at))
    seconds = (micros / 1_000_000).cast("decimal(18,6)")
    days = F.floor(micros / 86_400_000_000)
    rest = (seconds - days * 86400).cast("decimal(18,6)")
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(days=days.cast("int"), secs=rest)


def total_order(ts: str | Column, ids: tuple[str, ...]) -> Column:
    """One sortable value for ``(ts, *ids)``.

    With a single integer id the pair is packed into a decimal. Decimals have
    a fixed width, which keeps ``min_by``/``max_by`` in a hash aggregate; a
    struct would force Spark to sort all ticks before the partial aggregate.
    """
    if not ids:
        return col(ts)
    if len(ids) > 1:
        return F.struct(col(ts), *[F.col(i) for i in ids])
    # twice 10^19 exceeds the whole signed 64-bit range of the id
    scale = F.lit("20000000000000000000").cast("decimal(20,0)")
    return epoch_micros(ts).cast("decimal(18,0)") * scale + F.col(ids[0]).cast("decimal(19,0)")


def key_hash(key: str | Column) -> Column:
    """First 32 bits of the md5 of the key, as a long: the same on every engine."""
    digest = F.md5(col(key).cast("string"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def series_key(*parts: str) -> Column:
    """Text key such as ``series|2024-01-01 00:00:00`` for stable hashing."""
    return F.concat_ws(
        "|", *[F.date_format(p, "yyyy-MM-dd HH:mm:ss") if p == "ts" else F.col(p) for p in parts]
    )


def ratio(num: Column, den: Column) -> Column:
    """Division that is NULL, not an error, on a zero denominator."""
    return F.try_divide(num, den)


def oscillator(up: Column, down: Column) -> Column:
    """``100 - 100/(1 + up/down)``; 100 where only ``down`` is 0, NULL where both are."""
    return (
        F.when(down != 0, 100 - 100 / (1 + ratio(up, down)))
        .when(up > 0, F.lit(100.0))
        .otherwise(F.lit(None).cast("double"))
    )


def weekday(ts: str | Column) -> Column:
    """Monday = 0 … Sunday = 6."""
    return F.weekday(col(ts))


def minute_of_day(ts: str | Column) -> Column:
    return F.hour(col(ts)) * 60 + F.minute(col(ts))
