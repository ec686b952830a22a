"""Queries of the cleaning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.catalogue import query
from tidebar.catalogue.common import HASH, KEY, ctes, frame_ctes, over, rnd, rounded
from tidebar.functions.scalars import key_hash, series_key
from tidebar.operators import clean as C
from tidebar.operators import splits as V
from tidebar.operators.indicators import indicator_frame
from tidebar.plans import inputs as I
from tidebar.session import stage_once

_HIT = f"{HASH.format(KEY)} % 100 < 40"
_AHEAD = "(PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_GAPPY = {"g": f"SELECT *, CASE WHEN NOT ({_HIT}) THEN close END AS c FROM bars_h"}
_FWD = f"last_value(c IGNORE NULLS) OVER {over()}"
_BWD = f"first_value(c IGNORE NULLS) OVER {_AHEAD}"


def frame(spark, sf):
    """The finished indicator frame of the hourly bars, stored once."""
    return stage_once(spark, f"{sf}/frame_h", lambda: indicator_frame(I.bars_h(spark, sf), I.H))


def _gappy(spark, sf):
    return I.gappy(I.bars_h(spark, sf)).select("series", "ts", "close")


@query(
    "ensure_datetime",
    ctes("bars_h", g=f"SELECT *, CASE WHEN NOT ({_HIT}) THEN ts END AS c FROM bars_h")
    + f"SELECT series, ts, coalesce({_FWD}, {_BWD}, TIMESTAMP '2030-01-01') AS datetime FROM g",
)
def q_ensure_datetime(spark, sf):
    rows = I.bars_h(spark, sf)
    miss = key_hash(series_key("series", "ts")) % 100 < 40
    stamp = F.when(miss, F.lit("not a date")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    rows = rows.select("series", "ts", stamp.alias("Date"))
    now = F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")
    return C.ensure_datetime(rows, ["Datetime", "Date"], I.H, now)


@query("ffill", ctes("bars_h", **_GAPPY) + f"SELECT series, ts, {_FWD} AS close FROM g")
def q_ffill(spark, sf):
    return C.ffill(_gappy(spark, sf), I.H, ["close"])


@query("bfill", ctes("bars_h", **_GAPPY) + f"SELECT series, ts, {_BWD} AS close FROM g")
def q_bfill(spark, sf):
    return C.bfill(_gappy(spark, sf), I.H, ["close"])


@query("fill_zero", ctes("bars_h", **_GAPPY) + "SELECT series, ts, coalesce(c, 0) AS close FROM g")
def q_fill_zero(spark, sf):
    return C.fill_zero(_gappy(spark, sf), ["close"])


@query(
    "fill_chain",
    ctes("bars_h", **_GAPPY)
    + f"""SELECT series, ts, coalesce({_FWD}, {_BWD}) AS bars, coalesce({_FWD}, 0) AS indicators,
        coalesce({_BWD}, 0) AS features FROM g""",
)
def q_fill_chain(spark, sf):
    rows = _gappy(spark, sf)
    bars = C.fill_chain(rows, I.H, ["close"], ("ffill", "bfill")).withColumnRenamed("close", "bars")
    inds = C.fill_chain(rows, I.H, ["close"], ("ffill", "zero")).withColumnRenamed("close", "indicators")
    feats = C.fill_chain(rows, I.H, ["close"], ("bfill", "zero")).withColumnRenamed("close", "features")
    return bars.join(inds, ["series", "ts"]).join(feats, ["series", "ts"])


@query(
    "ensure_numeric",
    "SELECT event_id, try_cast(event_type AS DOUBLE) AS event_type, try_cast(CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE value::VARCHAR END AS DOUBLE) AS value FROM events",
)
def q_ensure_numeric(spark, sf):
    text = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("value").cast("string"))
    rows = I.table(spark, sf, "events").select("event_id", "event_type", text.alias("value"))
    return C.ensure_numeric(rows, ["event_type", "value"])


@query("drop_missing", ctes("bars_h", **_GAPPY) + "SELECT series, ts, c AS close FROM g WHERE c IS NOT NULL")
def q_drop_missing(spark, sf):
    return C.drop_missing(_gappy(spark, sf))


@query(
    "suffix_columns",
    ctes("bars_15m_all")
    + "SELECT series, ts, open AS open_15m, high AS high_15m, low AS low_15m, close AS close_15m, volume AS volume_15m FROM bars_15m_all",
)
def q_suffix(spark, sf):
    return C.suffix_columns(I.bars_15m_all(spark, sf), "_15m")


@query(
    "harmonise_price_column",
    ctes("bars_h", "macro")
    + "SELECT series, ts, close AS market_price FROM bars_h UNION ALL SELECT name, ts, value FROM macro",
)
def q_harmonise(spark, sf):
    bars = C.harmonise_price_column(I.bars_h(spark, sf).select("series", "ts", "close"), "market_price")
    other = I.macro(spark, sf).select(F.col("name").alias("series"), "ts", F.col("value").alias("price"))
    return bars.unionByName(C.harmonise_price_column(other, "market_price"))


_FRAME = ctes("bars_h", recursive=True, **frame_ctes("bars_h"))


@query(
    "encode_category",
    _FRAME + "SELECT series, ts, CASE impulse_color WHEN 'red' THEN -1 WHEN 'green' THEN 1 WHEN 'gray' THEN 0 END::INTEGER AS impulse_color FROM fr",
)
def q_encode(spark, sf):
    return frame(spark, sf).select("series", "ts", C.encode_category("impulse_color").alias("impulse_color"))


_MODEL = ("macd_histogram", "rsi", "upper_band", "lower_band", "atr", "adx", "ema9", "ema21")


@query("select_features", _FRAME + f"SELECT series, ts, {rnd(*_MODEL)}, impulse_color FROM fr")
def q_select_features(spark, sf):
    return rounded(C.select_features(frame(spark, sf), C.MODEL_FEATURES, ("close_augmented",)))


@query(
    "select_numeric",
    ctes("bars_h") + "SELECT series, ts, open, high, low, volume FROM bars_h",
)
def q_select_numeric(spark, sf):
    rows = I.bars_h(spark, sf).withColumn("label", F.lit("x"))
    return C.select_numeric(rows)


@query(
    "missing_audit",
    ctes("bars_h", **_GAPPY)
    + """, m AS (SELECT count(*) - count(c) AS c, count(*) - count(volume) AS v FROM g)
    SELECT 'close' AS column_name, c AS missing, c > 0 AS any_missing FROM m UNION ALL SELECT 'volume', v, v > 0 FROM m""",
)
def q_missing_audit(spark, sf):
    return C.missing_audit(I.gappy(I.bars_h(spark, sf)), ["close", "volume"])


@query(
    "constant_zero_check",
    _FRAME
    + """SELECT series, bool_and(rsi = 0) AS rsi_all_zero, bool_and(atr = 0) AS atr_all_zero, bool_and(adx = 0) AS adx_all_zero,
        bool_and(mfi = 0) AS mfi_all_zero FROM fr GROUP BY series""",
)
def q_zero_check(spark, sf):
    return C.constant_zero_check(frame(spark, sf), ["rsi", "atr", "adx", "mfi"])


@query(
    "nan_to_zero",
    ctes("bars_h", **_GAPPY) + "SELECT series, ts, coalesce(c, 0) AS predicted, c IS NULL AS was_missing FROM g",
)
def q_nan_to_zero(spark, sf):
    value, flag = C.nan_to_zero("close")
    return _gappy(spark, sf).select("series", "ts", value.alias("predicted"), flag.alias("was_missing"))


@query(
    "head_tail",
    ctes(
        "bars_h",
        r="""SELECT series, ts, close, row_number() OVER (PARTITION BY series ORDER BY ts) AS a,
            row_number() OVER (PARTITION BY series ORDER BY ts DESC) AS b FROM bars_h""",
    )
    + """SELECT series, ts, close, a::INTEGER AS rank, 'head' AS part FROM r WHERE a <= 5
       UNION ALL SELECT series, ts, close, b::INTEGER, 'tail' FROM r WHERE b <= 5""",
)
def q_head_tail(spark, sf):
    return C.head_tail(I.bars_h(spark, sf).select("series", "ts", "close"), 5)


# -- rows without a place in the order -------------------------------------------

_LOST = {
    "u": """SELECT CASE WHEN day(ts) % 11 = 5 THEN NULL ELSE series END AS series, CASE WHEN hour(ts) % 7 = 3 THEN NULL ELSE ts END AS ts,
        close, volume, high FROM bars_h""",
    "p": "SELECT *, CASE WHEN volume % 3 > 0 THEN close END AS c FROM u WHERE series IS NOT NULL AND ts IS NOT NULL",
    "q": f"SELECT series, ts, {_FWD} AS filled, row_number() OVER {over()} AS rn, count(*) OVER (PARTITION BY series) AS n, high FROM p",
}


@query(
    "rows_without_place",
    ctes("bars_h", **_LOST)
    + """SELECT series, ts, filled, high, CASE WHEN rn <= floor(0.75 * n) THEN 'train' ELSE 'test' END AS split FROM q
       UNION ALL SELECT series, ts, CASE WHEN volume % 3 > 0 THEN close END, high, NULL FROM u WHERE series IS NULL OR ts IS NULL""",
)
def q_rows_without_place(spark, sf):
    """Rows whose time or key is missing come through fills and splits: as many rows out as in."""
    rows = I.bars_h(spark, sf).select(
        F.when(F.dayofmonth("ts") % 11 != 5, F.col("series")).alias("series"),
        F.when(F.hour("ts") % 7 != 3, F.col("ts")).alias("ts"),
        F.when(F.col("volume") % 3 > 0, F.col("close")).alias("filled"),
        "high",
    )
    return V.chronological_split(C.ffill(rows, I.H, ["filled"]), I.H)
