"""Queries of the indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.catalogue import query
from tidebar.catalogue.common import (
    FRAME_DOUBLES,
    ctes,
    ewm_sql,
    frame_ctes,
    full,
    indicator_ctes,
    osc,
    over,
    rnd,
    rounded,
)
from tidebar.operators import indicators as ind
from tidebar.operators.ewm import ewm
from tidebar.plans import inputs as I
from tidebar.plans import zones

BARS = "series, ts"


def _on(bars, order, before, *steps, keep=()):
    """Zoned bars, the given steps on the window, then the kept columns."""
    z = zones.enter(bars, order, before=before)
    w = zones.window(order)
    for step in steps:
        z = step(z, w)
    return rounded(zones.leave(z).select("series", "ts", *keep))


def _ind_sql(*cols, source="bars_h"):
    return ctes(source, **indicator_ctes(source)) + f"SELECT series, ts, {rnd(*cols)} FROM ind"


@query(
    "ewm",
    ctes("bars_h", recursive=True, **ewm_sql("bars_h", {"ewm9": ("close", 9), "ewm26": ("close", 26), "ewm200": ("close", 200)}))
    + f"SELECT n.series, n.ts, {rnd('ewm9', 'ewm26', 'ewm200')} FROM ew JOIN num n USING (series, rn)",
)
def q_ewm(spark, sf):
    means = {"ewm9": ("close", 9), "ewm26": ("close", 26), "ewm200": ("close", 200)}
    return rounded(ewm(I.bars_h(spark, sf), I.H, means).select("series", "ts", *means))


@query(
    "ewm_single_series",
    ctes("bars_h_all", recursive=True, **ewm_sql("bars_h_all", {"ewm9": ("close", 9), "ewm21": ("close", 21)}))
    + f"SELECT n.series, n.ts, {rnd('ewm9', 'ewm21')} FROM ew JOIN num n USING (series, rn)",
)
def q_ewm_single(spark, sf):
    means = {"ewm9": ("close", 9), "ewm21": ("close", 21)}
    return rounded(ewm(I.bars_h_all(spark, sf), I.H, means).select("series", "ts", *means))


def _frame_sql(select, source="bars_h"):
    return ctes(source, recursive=True, **frame_ctes(source)) + f"SELECT series, ts, {select} FROM fr"


def _macd(spark, sf, *cols):
    z = ind.with_macd(zones.enter(I.bars_h(spark, sf), I.H), I.H)
    return rounded(zones.leave(z).select("series", "ts", *cols))


@query("macd", _frame_sql(rnd("ema12", "ema26", "macd")))
def q_macd(spark, sf):
    return _macd(spark, sf, "ema12", "ema26", "macd")


@query("macd_signal", _frame_sql(rnd("macd_signal")))
def q_macd_signal(spark, sf):
    return _macd(spark, sf, "macd_signal")


@query("macd_histogram", _frame_sql(rnd("macd_histogram")))
def q_macd_histogram(spark, sf):
    return _macd(spark, sf, "macd_histogram")


@query("rsi", _ind_sql("rsi"))
def q_rsi(spark, sf):
    return _on(I.bars_h(spark, sf), I.H, 16, ind.with_rsi, keep=("rsi",))


@query("sma", _ind_sql("sma20 AS sma"))
def q_sma(spark, sf):
    df = zones.over(I.bars_h(spark, sf), I.H, before=20, sma=lambda w: ind.sma("close", w))
    return rounded(df.select("series", "ts", "sma"))


@query("bollinger", _ind_sql("sma20", "upper_band", "lower_band"))
def q_bollinger(spark, sf):
    return _on(I.bars_h(spark, sf), I.H, 20, ind.bollinger, keep=("sma20", "upper_band", "lower_band"))


@query("prev_close", _ind_sql("prev_close"))
def q_prev_close(spark, sf):
    df = zones.over(I.bars_h(spark, sf), I.H, before=1, prev_close=lambda w: ind.previous("close", w))
    return rounded(df.select("series", "ts", "prev_close"))


@query("true_range", _ind_sql("tr"))
def q_true_range(spark, sf):
    return _on(I.bars_h(spark, sf), I.H, 1, ind.with_true_range, keep=("tr",))


@query("atr", _ind_sql("atr"))
def q_atr(spark, sf):
    return _on(I.bars_h(spark, sf), I.H, 16, ind.with_true_range, ind.with_atr, keep=("atr",))


@query("directional_movement", _ind_sql("plus_dm", "minus_dm"))
def q_dm(spark, sf):
    return _on(I.bars_h(spark, sf), I.H, 1, ind.with_directional_movement, keep=("plus_dm", "minus_dm"))


DI = (ind.with_true_range, ind.with_directional_movement, ind.with_directional_index)


@query("directional_index", _ind_sql("plus_di", "minus_di"))
def q_di(spark, sf):
    return _on(I.bars_h(spark, sf), I.H, 16, *DI, keep=("plus_di", "minus_di"))


@query("adx", _ind_sql("adx"))
def q_adx(spark, sf):
    return _on(I.bars_h(spark, sf), I.H, 32, *DI, ind.with_adx, keep=("adx",))


@query(
    "ema_pair",
    ctes("bars_d", recursive=True, **ewm_sql("bars_d", {"ema9": ("close", 9), "ema21": ("close", 21)}))
    + f"SELECT n.series, n.ts, {rnd('ema9', 'ema21', places=4)} FROM ew JOIN num n USING (series, rn)",
)
def q_ema_pair(spark, sf):
    means = {"ema9": ("close", 9), "ema21": ("close", 21)}
    return rounded(ewm(I.bars_d(spark, sf), I.D, means).select("series", "ts", *means), 4)


@query(
    "money_flow",
    ctes("bars_d_flag", **indicator_ctes("bars_d_flag"))
    + "SELECT series, ts, tp AS typical_price, mf AS money_flow FROM ind",
)
def q_money_flow(spark, sf):
    z = ind.with_money_flow(zones.enter(I.bars_d_flag(spark, sf), I.D, before=1), zones.window(I.D))
    return zones.leave(z).select("series", "ts", "typical_price", "money_flow")


@query("mfi", _ind_sql("mfi", source="bars_d_flag"))
def q_mfi(spark, sf):
    return _on(I.bars_d_flag(spark, sf), I.D, 16, ind.with_money_flow, ind.with_mfi, keep=("mfi",))


@query("impulse_copy", _frame_sql(rnd("impulse_macd", "impulse_rsi")))
def q_impulse_copy(spark, sf):
    z = zones.enter(I.bars_h(spark, sf), I.H, before=16)
    z = ind.with_rsi(z, zones.window(I.H))
    z = ind.with_macd(z, I.H)
    df = zones.leave(z).withColumns({"impulse_macd": F.col("macd"), "impulse_rsi": F.col("rsi")})
    return rounded(df.select("series", "ts", "impulse_macd", "impulse_rsi"))


@query("impulse_color", _frame_sql("impulse_color"))
def q_impulse_color(spark, sf):
    z = zones.enter(I.bars_h(spark, sf), I.H, before=17)
    w = zones.window(I.H)
    z = ind.with_rsi(z, w).withColumn("_before", ind.previous("rsi", w))
    z = ind.with_macd(z, I.H)
    z = z.withColumn("impulse_color", ind.impulse_color("macd_histogram", "rsi", "_before"))
    return zones.leave(z).select("series", "ts", "impulse_color")


FINAL = ("plus_di", "minus_di", "adx", "mfi", "atr", "sma20", "upper_band", "lower_band", "prev_close")


@query("finalise_indicators", _frame_sql(rnd(*FINAL), "bars_d").replace(", 6)", ", 4)"))
def q_finalise(spark, sf):
    return rounded(ind.indicator_frame(I.bars_d(spark, sf), I.D).select("series", "ts", *FINAL), 4)


@query(
    "indicator_frame",
    _frame_sql(f"{rnd('open', 'high', 'low', 'close')}, volume, {rnd(*FRAME_DOUBLES)}, impulse_color"),
)
def q_indicator_frame(spark, sf):
    return rounded(ind.indicator_frame(I.bars_h(spark, sf), I.H))


@query(
    "simple_impulse",
    ctes("bars_h", a=f"SELECT series, ts, close - lag(close) OVER {over()} AS d FROM bars_h")
    + "SELECT series, ts, CASE WHEN d > 0 THEN 'green' WHEN d < 0 THEN 'red' ELSE 'gray' END AS impulse_color FROM a",
)
def q_simple_impulse(spark, sf):
    df = zones.over(I.bars_h(spark, sf), I.H, before=1, impulse_color=lambda w: ind.simple_impulse("close", w))
    return df.select("series", "ts", "impulse_color")


@query(
    "macd_12_26",
    ctes("bars_h", recursive=True, **ewm_sql("bars_h", {"f": ("close", 12), "s": ("close", 26)}))
    + f"SELECT n.series, n.ts, {rnd('f - s AS macd_histogram')} FROM ew JOIN num n USING (series, rn)",
)
def q_macd_12_26(spark, sf):
    df = ewm(I.bars_h(spark, sf), I.H, {"f": ("close", 12), "s": ("close", 26)})
    return rounded(df.select("series", "ts", (F.col("f") - F.col("s")).alias("macd_histogram")))


_SHORT = over(14)


@query(
    "rsi_min1",
    ctes(
        "bars_h",
        a=f"SELECT series, ts, coalesce(close - lag(close) OVER {over()}, 0) AS d FROM bars_h",
        b=f"SELECT series, ts, avg(greatest(d, 0)) OVER {_SHORT} AS g, avg(greatest(-d, 0)) OVER {_SHORT} AS l FROM a",
        c=f"SELECT series, ts, {osc('g', 'l')} AS r FROM b",
        d="""SELECT series, ts, coalesce(first_value(r IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS rsi FROM c""",
    )
    + f"SELECT series, ts, {rnd('rsi')} FROM d",
)
def q_rsi_min1(spark, sf):
    return rounded(ind.rsi_min1(I.bars_h(spark, sf), I.H).select("series", "ts", "rsi"))


def _back(c):
    return (
        f"coalesce(first_value({c} IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts"
        f" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS {c}"
    )


@query(
    "bollinger_bfill",
    ctes("bars_h", **indicator_ctes("bars_h"), b=f"SELECT series, ts, {_back('upper_band')}, {_back('lower_band')} FROM ind")
    + f"SELECT series, ts, {rnd('upper_band', 'lower_band')} FROM b",
)
def q_bollinger_bfill(spark, sf):
    return rounded(ind.bollinger_bfill(I.bars_h(spark, sf), I.H).select("series", "ts", "upper_band", "lower_band"))


EMAS = {f"ema{n}": ("close", n) for n in (9, 21, 50, 200)}


@query(
    "ema_set",
    ctes("bars_h", recursive=True, **ewm_sql("bars_h", EMAS))
    + f"SELECT n.series, n.ts, {rnd(*EMAS)} FROM ew JOIN num n USING (series, rn)",
)
def q_ema_set(spark, sf):
    return rounded(ewm(I.bars_h(spark, sf), I.H, EMAS).select("series", "ts", *EMAS))


@query(
    "macd_standard",
    ctes("bars_h", recursive=True, **ewm_sql("bars_h", {"f": ("close", 12), "s": ("close", 26)}, ("f", "s", 9)))
    + f"""SELECT n.series, n.ts, {rnd('f - s AS macd', 'sig AS macd_signal', 'f - s - sig AS macd_histogram')},
        sign(round(f - s - sig, 6))::INTEGER AS impulse_macd FROM ew JOIN num n USING (series, rn)""",
)
def q_macd_standard(spark, sf):
    z = ind.with_macd(zones.enter(I.bars_h(spark, sf), I.H), I.H, 12, 26, 9)
    z = z.withColumn("impulse_macd", F.signum(F.round("macd_histogram", ind.PLACES)).cast("int"))
    return rounded(zones.leave(z).select("series", "ts", "macd", "macd_signal", "macd_histogram", "impulse_macd"))


@query(
    "rsi_inner",
    ctes(
        "bars_h",
        a=f"SELECT series, ts, close, close - lag(close) OVER {over()} AS d FROM bars_h",
        b=f"""SELECT series, ts, sum(greatest(d, 0)) OVER {over(13)} AS g, sum(greatest(-d, 0)) OVER {over(13)} AS l,
            count(close) OVER {over(14)} AS n FROM a""",
    )
    + f"SELECT series, ts, round(CASE WHEN n >= 14 THEN {osc('g', 'l')} END, 6) AS rsi FROM b",
)
def q_rsi_inner(spark, sf):
    return _on(I.bars_h(spark, sf), I.H, 16, ind.with_rsi_inner, keep=("rsi",))


@query(
    "mfi_variant",
    ctes(
        "bars_d_flag",
        **indicator_ctes("bars_d_flag"),
        v=f"SELECT series, ts, pf14 / nullif(nf14, 0) AS mfr, {osc('pf14', 'nf14')} AS mfi FROM ind",
    )
    + f"SELECT series, ts, {rnd('mfr', 'mfi')} FROM v",
)
def q_mfi_variant(spark, sf):
    return _on(I.bars_d_flag(spark, sf), I.D, 16, ind.with_mfi_variant, keep=("mfr", "mfi"))


_HLC = {
    "r1": f"""SELECT *, greatest(high, low, close) - least(high, low, close) AS tr,
        high - lag(high) OVER {over()} AS u, lag(low) OVER {over()} - low AS v FROM bars_h""",
    "r2": f"""SELECT *, {full('avg', 'tr', 14)} AS atr, CASE WHEN u > v THEN u ELSE 0.0 END AS plus_dm,
        CASE WHEN v > u THEN v ELSE 0.0 END AS minus_dm FROM r1""",
    "r3": "SELECT *, plus_dm / nullif(atr, 0) AS p, minus_dm / nullif(atr, 0) AS m FROM r2",
    "r4": f"SELECT *, 100 * ({full('avg', 'p', 14)}) AS plus_di, 100 * ({full('avg', 'm', 14)}) AS minus_di FROM r3",
    "r5": "SELECT *, 100 * (abs(plus_di - minus_di) / nullif(abs(plus_di + minus_di), 0)) AS dx FROM r4",
    "r6": f"SELECT *, {full('avg', 'dx', 14)} AS adx FROM r5",
}


@query("atr_hlc", ctes("bars_h", **_HLC) + f"SELECT series, ts, {rnd('tr', 'atr')} FROM r6")
def q_atr_hlc(spark, sf):
    return _on(I.bars_h(spark, sf), I.H, 16, ind.with_range_hlc, keep=("tr", "atr"))


@query("dm_exclusive", ctes("bars_h", **_HLC) + f"SELECT series, ts, {rnd('plus_dm', 'minus_dm')} FROM r6")
def q_dm_exclusive(spark, sf):
    return _on(I.bars_h(spark, sf), I.H, 1, ind.with_dm_exclusive, keep=("plus_dm", "minus_dm"))


@query("adx_variant", ctes("bars_h", **_HLC) + f"SELECT series, ts, {rnd('plus_di', 'minus_di', 'dx', 'adx')} FROM r6")
def q_adx_variant(spark, sf):
    return _on(I.bars_h(spark, sf), I.H, 48, ind.with_adx_variant, keep=("plus_di", "minus_di", "dx", "adx"))


_SEQ = {**ewm_sql("bars_h", {"f": ("close", 12), "s": ("close", 26), **EMAS}, ("f", "s", 9)), **indicator_ctes("bars_h"), **_HLC}


@query(
    "sequence_indicators",
    ctes(
        "bars_h",
        recursive=True,
        **_SEQ,
        k=f"""SELECT *, close - lag(close) OVER {over()} AS d2 FROM bars_h""",
        k2=f"""SELECT series, ts, sum(greatest(d2, 0)) OVER {over(13)} AS g, sum(greatest(-d2, 0)) OVER {over(13)} AS l,
            count(close) OVER {over(14)} AS n FROM k""",
    )
    + f"""SELECT i.series, i.ts, {rnd('ema9', 'ema21', 'ema50', 'ema200', 'f - s AS macd', 'sig AS macd_signal')},
        round(CASE WHEN n >= 14 THEN {osc('g', 'l')} END, 6) AS rsi, {rnd('i.upper_band AS upper_band', 'i.lower_band AS lower_band')},
        round({osc('pf14', 'nf14')}, 6) AS mfi, {rnd('r6.atr AS atr', 'r6.adx AS adx')},
        sign(round(f - s - sig, 6))::INTEGER AS impulse_macd
        FROM ind i JOIN ew ON ew.series = i.series AND ew.rn = i.rn
        JOIN r6 ON r6.series = i.series AND r6.ts = i.ts JOIN k2 ON k2.series = i.series AND k2.ts = i.ts""",
)
def q_sequence_indicators(spark, sf):
    cols = (
        "ema9", "ema21", "ema50", "ema200", "macd", "macd_signal", "rsi", "upper_band", "lower_band", "mfi", "atr", "adx",
        "impulse_macd",
    )
    return rounded(ind.sequence_indicators(I.bars_h(spark, sf), I.H).select("series", "ts", *cols))
