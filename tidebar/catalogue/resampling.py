"""Queries of calendar grids, alignment and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.catalogue import query
from tidebar.catalogue.common import CTES, ctes, ewm_sql, full, osc, over, rnd, rounded
from tidebar.operators import enrich
from tidebar.operators import resample as R
from tidebar.plans import inputs as I
from tidebar.session import stage, stage_once

_GRID = {
    "grid": """SELECT series, unnest(generate_series(min(ts), max(ts), INTERVAL '15 minutes')) AS ts FROM {0} GROUP BY series""",
}
_MIN = "(hour(ts) * 60 + minute(ts)) BETWEEN 570 AND 960"


def _grid(source):
    return _GRID["grid"].format(source)


@query("calendar_grid", ctes("bars_h", grid=_grid("bars_h")) + "SELECT series, ts FROM grid")
def q_grid(spark, sf):
    return R.calendar_grid(R.series_bounds(I.bars_h(spark, sf)))


@query("weekday_filter", ctes("bars_15m_all") + "SELECT series, ts, close FROM bars_15m_all WHERE isodow(ts) <= 5")
def q_weekday(spark, sf):
    return I.bars_15m_all(spark, sf).where(R.weekday_filter("ts")).select("series", "ts", "close")


@query("between_time", ctes("bars_15m_all") + f"SELECT series, ts, close FROM bars_15m_all WHERE {_MIN}")
def q_between_time(spark, sf):
    return I.bars_15m_all(spark, sf).where(R.between_time("ts")).select("series", "ts", "close")


@query(
    "market_grid",
    ctes("bars_15m_all", grid=_grid("bars_15m_all")) + f"SELECT series, ts FROM grid WHERE isodow(ts) <= 5 AND {_MIN}",
)
def q_market_grid(spark, sf):
    return R.calendar_grid(R.series_bounds(I.bars_15m_all(spark, sf)), weekdays_only=True, market_hours=True)


@query(
    "upsample_asfreq",
    ctes("bars_h_all", grid=_grid("bars_h_all"))
    + "SELECT grid.series, grid.ts, close FROM grid LEFT JOIN bars_h_all b ON b.series = grid.series AND b.ts = grid.ts",
)
def q_upsample(spark, sf):
    return R.upsample_asfreq(I.bars_h_all(spark, sf).select("series", "ts", "close"))


def _interpolate(source: str, c: str, name: str) -> dict[str, str]:
    """CTEs: linear interpolation of ``c`` by row position within ``source``."""
    fwd, bwd = over(), "(PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return {
        f"{name}_i": f"SELECT *, row_number() OVER {fwd} AS i FROM {source}",
        f"{name}_k": f"""SELECT *, last_value(CASE WHEN {c} IS NOT NULL THEN i END IGNORE NULLS) OVER {fwd} AS ip,
            last_value({c} IGNORE NULLS) OVER {fwd} AS p, first_value(CASE WHEN {c} IS NOT NULL THEN i END IGNORE NULLS) OVER {bwd} AS iq,
            first_value({c} IGNORE NULLS) OVER {bwd} AS q FROM {name}_i""",
        name: f"""SELECT * EXCLUDE ({c}, i, ip, p, iq, q), CASE WHEN {c} IS NOT NULL THEN {c} WHEN q IS NULL THEN p
            ELSE p + (q - p) * ((i - ip)::DOUBLE / nullif(iq - ip, 0)) END AS {c} FROM {name}_k""",
    }


_UP = """SELECT grid.series, grid.ts, close FROM grid LEFT JOIN bars_h_all b ON b.series = grid.series AND b.ts = grid.ts"""


@query(
    "interpolate_linear",
    ctes("bars_h_all", grid=_grid("bars_h_all"), up=_UP, **_interpolate("up", "close", "it"))
    + f"SELECT series, ts, {rnd('close')} FROM it",
)
def q_interpolate(spark, sf):
    up = stage_once(
        spark, f"{sf}/up_h_all", lambda: R.upsample_asfreq(I.bars_h_all(spark, sf).select("series", "ts", "close"))
    )
    return rounded(R.interpolate_linear(up, I.Q, ["close"]))


_UNION = """SELECT series, ts, close, volume, '15m' AS resolution FROM bars_15m_all
    UNION ALL SELECT series, ts, close, NULL, '1h' FROM bars_h_all UNION ALL SELECT series, ts, close, NULL, '1d' FROM bars_d_all"""


def _parts(spark, sf):
    return {
        "15m": I.bars_15m_all(spark, sf).select("series", "ts", "close", "volume"),
        "1h": I.bars_h_all(spark, sf).select("series", "ts", "close"),
        "1d": I.bars_d_all(spark, sf).select("series", "ts", "close"),
    }


@query("union_resolutions", ctes("bars_15m_all", "bars_h_all", "bars_d_all") + _UNION)
def q_union(spark, sf):
    return R.union_resolutions(_parts(spark, sf))


def _dedup_sql(order):
    rank = "CASE resolution WHEN '15m' THEN 0 WHEN '1h' THEN 1 ELSE 2 END"
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series, ts ORDER BY {rank} {order}) AS k FROM u) WHERE k = 1"


@query(
    "dedup_precedence",
    ctes("bars_15m_all", "bars_h_all", "bars_d_all", u=_UNION, d=_dedup_sql("ASC"))
    + "SELECT series, ts, close, volume, resolution FROM d",
)
def q_dedup(spark, sf):
    return R.dedup_precedence(R.union_resolutions(_parts(spark, sf)))


@query(
    "dedup_precedence_coarse",
    ctes("bars_15m_all", "bars_h_all", "bars_d_all", u=_UNION, d=_dedup_sql("DESC"))
    + "SELECT series, ts, close, volume, resolution FROM d",
)
def q_dedup_coarse(spark, sf):
    return R.dedup_precedence(R.union_resolutions(_parts(spark, sf)), "coarse")


@query(
    "reindex",
    ctes("bars_15m_all", grid=_grid("bars_15m_all"), g=f"SELECT * FROM grid WHERE isodow(ts) <= 5 AND {_MIN}")
    + "SELECT g.series, g.ts, close FROM g LEFT JOIN bars_15m_all b ON b.series = g.series AND b.ts = g.ts",
)
def q_reindex(spark, sf):
    bars = I.bars_15m_all(spark, sf)
    grid = R.calendar_grid(R.series_bounds(bars), weekdays_only=True, market_hours=True)
    return R.reindex(grid, bars.select("series", "ts", "close"))


def _year() -> str:
    up = "SELECT grid_{0}.series, grid_{0}.ts, close FROM grid_{0} LEFT JOIN {1} b ON b.series = grid_{0}.series AND b.ts = grid_{0}.ts"
    bwd = "(PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"

    def back(c):
        return f"coalesce(first_value({c} IGNORE NULLS) OVER {bwd}, 0) AS {c}"

    lags = [f"lag(close, {k}) OVER {over()} AS close_lag_{k}" for k in (1, 2, 3)]
    means = [f"{full('avg', 'close', n)} AS close_ma_{n}" for n in (5, 10, 15)]
    filled = [f"close_lag_{k}" for k in (1, 2, 3)] + [f"close_ma_{n}" for n in (5, 10, 15)] + ["rsi", "upper_band", "lower_band"]
    parts = {
        "grid_h": _grid("bars_h_all"),
        "up_h": up.format("h", "bars_h_all"),
        **_interpolate("up_h", "close", "it_h"),
        "grid_d": _grid("bars_d_all"),
        "up_d": up.format("d", "bars_d_all"),
        **_interpolate("up_d", "close", "it_d"),
        "u": """SELECT series, ts, close, volume::DOUBLE AS volume, '15m' AS resolution FROM bars_15m_all
            UNION ALL SELECT series, ts, close, NULL, '1h' FROM it_h UNION ALL SELECT series, ts, close, NULL, '1d' FROM it_d""",
        "dd": _dedup_sql("ASC"),
        "mx": "SELECT max(ts) AS last FROM dd",
        "yr": "SELECT series, ts, close, volume FROM dd, mx WHERE ts >= last - INTERVAL '365 days'",
        "gy": _grid("yr"),
        "gm": f"SELECT * FROM gy WHERE isodow(ts) <= 5 AND {_MIN}",
        "al": "SELECT gm.series, gm.ts, y.close, y.volume FROM gm LEFT JOIN yr y ON y.series = gm.series AND y.ts = gm.ts",
        **_interpolate("al", "close", "iy"),
        "src": "SELECT series, ts, coalesce(close, 0) AS close, coalesce(volume, 0) AS volume FROM iy",
        **ewm_sql("src", {"f": ("close", 12), "s": ("close", 26)}),
        "f1": f"SELECT *, coalesce(close - lag(close) OVER {over()}, 0) AS d FROM num",
        "f2": f"""SELECT *, avg(greatest(d, 0)) OVER {over(14)} AS g, avg(greatest(-d, 0)) OVER {over(14)} AS l,
            {full('avg', 'close', 20)} AS m, {full('stddev_samp', 'close', 20)} AS sd, {', '.join(lags + means)} FROM f1""",
        "f3": f"SELECT *, {osc('g', 'l')} AS rsi, m + 2 * sd AS upper_band, m - 2 * sd AS lower_band FROM f2",
        "f4": f"SELECT series, ts, rn, close, volume, d, {', '.join(back(c) for c in filled)} FROM f3",
    }
    names = ["close", "volume", *filled]
    return (
        ctes("bars_15m_all", "bars_h_all", "bars_d_all", recursive=True, **parts)
        + f"""SELECT f4.series, ts, {rnd(*names, 'f - s AS macd_histogram')},
        CASE WHEN d > 0 THEN 'green' WHEN d < 0 THEN 'red' ELSE 'gray' END AS impulse_color,
        (isodow(ts) - 1)::INTEGER AS day_of_week, hour(ts)::INTEGER AS hour_of_day
        FROM f4 JOIN ew ON ew.series = f4.series AND ew.rn = f4.rn"""
    )


YEAR_COLUMNS = (
    "close", "volume", "close_lag_1", "close_lag_2", "close_lag_3", "close_ma_5", "close_ma_10", "close_ma_15", "rsi",
    "upper_band", "lower_band", "macd_histogram", "impulse_color", "day_of_week", "hour_of_day",
)


@query("year_of_15min", _year())
def q_year(spark, sf):
    bars = I.bars_15m_all(spark, sf), I.bars_h_all(spark, sf), I.bars_d_all(spark, sf)
    return rounded(R.year_of_15min(*bars, I.Q, stage=stage).select("series", "ts", *YEAR_COLUMNS))


@query(
    "positional_align",
    ctes("bars_h", "bars_h_all")
    + "SELECT b.series, b.ts, b.close, a.close AS all_close FROM bars_h b JOIN bars_h_all a ON a.ts = b.ts",
)
def q_align(spark, sf):
    whole = I.bars_h_all(spark, sf).select("ts", F.col("close").alias("all_close"))
    return R.positional_align(I.bars_h(spark, sf).select("series", "ts", "close"), whole, ("ts",))


# -- as-of joins ---------------------------------------------------------------


@query(
    "asof_enrich",
    ctes("bars_d", "macro")
    + "SELECT b.series, b.ts, b.close, m.value AS macro_value FROM bars_d b ASOF LEFT JOIN macro m ON b.ts >= m.ts",
)
def q_asof(spark, sf):
    right = I.macro(spark, sf).select("ts", F.col("value").alias("macro_value"))
    return enrich.asof_calendar(I.bars_d(spark, sf).select("series", "ts", "close"), right, ["macro_value"])


@query(
    "asof_enrich_keyed",
    ctes("bars_h")
    + """, e AS (SELECT event_type AS series, ts, event_id, value FROM events)
    SELECT e.series, e.event_id, e.value, b.ts AS bar_ts, b.close AS bar_close FROM e
    ASOF LEFT JOIN bars_h b ON e.series = b.series AND e.ts >= b.ts + INTERVAL '1 hour'""",
)
def q_asof_keyed(spark, sf):
    events = I.table(spark, sf, "events").select(F.col("event_type").alias("series"), "ts", "event_id", "value")
    done = I.bars_h(spark, sf).select(
        "series",
        (F.col("ts") + F.expr("interval 1 hour")).alias("ts"),
        F.col("ts").alias("bar_ts"),
        F.col("close").alias("bar_close"),
    )
    out = enrich.asof_enrich(events, done, ["bar_ts", "bar_close"], ("series",))
    return out.select("series", "event_id", "value", "bar_ts", "bar_close")
