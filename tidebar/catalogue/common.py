"""Rounding and SQL fragments shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """All double columns rounded, as in the SQL."""
    return df.select(
        *[
            F.round(f.name, places).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def rnd(*columns: str, places: int = 6) -> str:
    """SQL list of rounded columns; adding 0 turns a negative zero into zero."""
    out = []
    for c in columns:
        expr, _, name = c.rpartition(" AS ")
        out.append(f"round({expr or c}, {places}) + 0.0 AS {name if expr else c}")
    return ", ".join(out)


def bars_sql(source: str, series: str, bar: str, price: str, ids: str, volume: str = "count(*)", ts: str = "ts") -> str:
    return f"""SELECT {series} AS series, {bar} AS ts,
        first({price} ORDER BY {ts}, {ids}) AS open, max({price}) AS high, min({price}) AS low,
        last({price} ORDER BY {ts}, {ids}) AS close, {volume} AS volume
        FROM {source} GROUP BY 1, 2"""


_LINE_PRICE = "l_extendedprice / l_quantity"
_LINE_IDS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
HASH = "('0x' || substr(md5({}::VARCHAR), 1, 8))::BIGINT"
KEY = "series || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S')"

CTES = {
    "bars_5m_all": bars_sql("events", "'ALL'", "time_bucket(INTERVAL '5 minutes', ts)", "value", "event_id"),
    "bars_15m_all": bars_sql("events", "'ALL'", "time_bucket(INTERVAL '15 minutes', ts)", "value", "event_id"),
    "bars_h": bars_sql("events", "event_type", "date_trunc('hour', ts)", "value", "event_id"),
    "bars_h_all": bars_sql("events", "'ALL'", "date_trunc('hour', ts)", "value", "event_id"),
    "bars_d_all": bars_sql("events", "'ALL'", "date_trunc('day', ts)::TIMESTAMP", "value", "event_id"),
    "bars_d": bars_sql(
        "orders", "o_orderpriority", "date_trunc('day', o_orderdate)::TIMESTAMP", "o_totalprice", "o_orderkey",
        ts="o_orderdate",
    ),
    "bars_d_flag": bars_sql(
        "lineitem", "l_returnflag", "date_trunc('day', l_shipdate)::TIMESTAMP", _LINE_PRICE, _LINE_IDS,
        "sum(l_quantity)", ts="l_shipdate",
    ),
    "macro": """SELECT 'orders' AS name, date_trunc('month', o_orderdate)::TIMESTAMP AS ts,
        round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2""",
    "quotes": f"""SELECT 'ALL' AS underlying, date_trunc('month', l_shipdate)::TIMESTAMP AS expiry,
        CASE WHEN l_linenumber % 2 = 1 THEN 'call' ELSE 'put' END AS kind, {_LINE_PRICE} AS strike, l_discount AS iv
        FROM lineitem""",
    "articles": """SELECT doc_id, lang, source, text, split_part(text, chr(10), 1) AS title,
        TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id::INTEGER) AS published_at FROM documents""",
}


def ctes(*names: str, recursive: bool = False, **extra: str) -> str:
    """``WITH`` clause of the named inputs, then ``extra`` ones."""
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in names]
    parts += [f"{n} AS ({body})" for n, body in extra.items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"


def over(n: int | None = None, ahead: int = 0) -> str:
    base = "PARTITION BY series ORDER BY ts"
    if n is None:
        return f"({base})"
    return f"({base} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {over(n)} >= {n} THEN {agg}({x}) OVER {over(n)} END"


def osc(up: str, down: str) -> str:
    return (
        f"CASE WHEN {down} <> 0 THEN 100 - 100 / (1 + {up} / nullif({down}, 0)) WHEN {up} > 0 THEN 100.0 END"
    )


def ewm_sql(source: str, means: dict[str, tuple[str, float]], signal: tuple[str, str, float] | None = None) -> dict[str, str]:
    """Recursive form: CTEs ``num`` and ``ew``; ``signal`` smooths the difference of two means."""
    first = [f"CAST({c} AS DOUBLE) AS {o}" for o, (c, _) in means.items()]

    def step(o: str) -> str:
        c, span = means[o]
        return f"(2.0 / {span + 1}) * n.{c} + (1 - 2.0 / {span + 1}) * e.{o}"

    later = [step(o) for o in means]
    if signal:
        fast, slow, span = signal
        first.append("CAST(0 AS DOUBLE) AS sig")
        later.append(f"(2.0 / {span + 1}) * (({step(fast)}) - ({step(slow)})) + (1 - 2.0 / {span + 1}) * e.sig")
    return {
        "num": f"SELECT *, row_number() OVER {over()} AS rn FROM {source}",
        "ew": f"""SELECT series, rn, {', '.join(first)} FROM num WHERE rn = 1
            UNION ALL
            SELECT n.series, n.rn, {', '.join(later)} FROM ew e JOIN num n ON n.series = e.series AND n.rn = e.rn + 1""",
    }


def indicator_ctes(source: str) -> dict[str, str]:
    """CTEs up to ``ind``: every indicator column before the final fill, and ``fin`` after it."""
    w = over()
    out = {
        "s1": f"""SELECT *, lag(close) OVER {w} AS prev_close, coalesce(close - lag(close) OVER {w}, 0) AS d,
            high - lag(high) OVER {w} AS dh, low - lag(low) OVER {w} AS dl, (high + low + close) / 3 AS tp FROM {source}""",
        "s2": f"""SELECT *, greatest(high - low, abs(high - prev_close), abs(low - prev_close)) AS tr,
            greatest(d, 0) AS up, greatest(-d, 0) AS down,
            CASE WHEN dh IS NOT NULL THEN greatest(dh, 0) END AS plus_dm,
            CASE WHEN dl IS NOT NULL THEN abs(least(dl, 0)) END AS minus_dm,
            tp * volume AS mf, tp - lag(tp) OVER {w} AS dtp FROM s1""",
        "s3": "SELECT *, CASE WHEN dtp > 0 THEN mf ELSE 0.0 END AS pf, CASE WHEN dtp < 0 THEN mf ELSE 0.0 END AS nf FROM s2",
        "s4": f"""SELECT *, {full('avg', 'up', 14)} AS g14, {full('avg', 'down', 14)} AS l14,
            {full('avg', 'close', 20)} AS sma20, {full('stddev_samp', 'close', 20)} AS sd20,
            {full('avg', 'tr', 14)} AS atr, {full('sum', 'tr', 14)} AS tr14,
            {full('sum', 'plus_dm', 14)} AS pdm14, {full('sum', 'minus_dm', 14)} AS mdm14,
            {full('sum', 'pf', 14)} AS pf14, {full('sum', 'nf', 14)} AS nf14 FROM s3""",
        "s5": f"""SELECT *, coalesce({osc('g14', 'l14')}, 0) AS rsi, sma20 + 2 * sd20 AS upper_band,
            sma20 - 2 * sd20 AS lower_band, 100 * (pdm14 / nullif(tr14, 0)) AS plus_di,
            100 * (mdm14 / nullif(tr14, 0)) AS minus_di, coalesce({osc('pf14', 'nf14')}, 0) AS mfi FROM s4""",
        "s6": "SELECT *, abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx FROM s5",
        "ind": f"""SELECT *, coalesce(100 * ({full('avg', 'dx', 14)}), 0) AS adx, lag(rsi) OVER {w} AS prev_rsi,
            row_number() OVER {w} AS rn FROM s6""",
    }
    return out


MEANS = {"e8": ("close", 8), "e21": ("close", 21), "e9": ("close", 9)}


def frame_ctes(source: str) -> dict[str, str]:
    """CTEs up to ``fr``: the finished indicator frame."""
    keep = "PARTITION BY i.series ORDER BY i.ts"
    e = ewm_sql(source, MEANS, ("e8", "e21", 9))
    fr = f"""SELECT i.series, i.ts, i.open, i.high, i.low, i.close, i.volume, i.rn,
        e8 AS ema12, e21 AS ema26, e8 - e21 AS macd, sig AS macd_signal, e8 - e21 - sig AS macd_histogram,
        rsi, {', '.join(f'coalesce(last_value({c} IGNORE NULLS) OVER ({keep}), 0) AS {c}' for c in ('sma20', 'upper_band', 'lower_band', 'prev_close', 'atr'))}, tr,
        coalesce(last_value(plus_di IGNORE NULLS) OVER ({keep}), 0) AS plus_di,
        coalesce(last_value(minus_di IGNORE NULLS) OVER ({keep}), 0) AS minus_di,
        adx, e9 AS ema9, e21 AS ema21, mfi, e8 - e21 AS impulse_macd, rsi AS impulse_rsi,
        CASE WHEN e8 - e21 - sig > 1e-9 * abs(close) AND round(rsi, 6) > round(prev_rsi, 6) THEN 'green'
             WHEN e8 - e21 - sig < -1e-9 * abs(close) AND round(rsi, 6) < round(prev_rsi, 6) THEN 'red' ELSE 'gray' END AS impulse_color
        FROM ind i JOIN ew ON ew.series = i.series AND ew.rn = i.rn"""
    return {**e, **indicator_ctes(source), "fr": fr}


FRAME_DOUBLES = (
    "ema12", "ema26", "macd", "macd_signal", "macd_histogram", "rsi", "sma20", "upper_band", "lower_band", "prev_close",
    "tr", "atr", "plus_di", "minus_di", "adx", "ema9", "ema21", "mfi", "impulse_macd", "impulse_rsi",
)
