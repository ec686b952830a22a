"""Queries of signals, trades and backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.catalogue import query
from tidebar.catalogue.cleaning import frame
from tidebar.catalogue.common import HASH, KEY, ctes, frame_ctes, full, indicator_ctes, over, rnd, rounded
from tidebar.functions.scalars import key_hash, series_key
from tidebar.operators import trades as T
from tidebar.operators.indicators import full as full_frame
from tidebar.operators.indicators import sma
from tidebar.operators.models import weighted_combine
from tidebar.operators.signals import (
    STRATEGIES,
    band_signals_from_bars,
    signal_counts,
    signals_from_bars,
    trade_signals,
)
from tidebar.plans import inputs as I
from tidebar.plans import zones
from tidebar.plans.zones import Order

# Means are compared after rounding to 6 places, as in the operators.
_CALM = f"(atr < {full('avg', 'atr', 10)})"
_NEUTRAL = "rsi > 40 AND rsi < 60"
_W = "(upper_band - lower_band)"
_SIGNALS = {
    "debit_spread_call": "ema9 - ema21 > 1e-9 * abs(close) AND macd - macd_signal > 1e-9 * abs(close) AND rsi < 70",
    "debit_spread_put": "ema9 - ema21 < -1e-9 * abs(close) AND macd - macd_signal < -1e-9 * abs(close) AND rsi > 30",
    "credit_spread_put": "close > lower_band AND rsi > 40 AND ema9 - ema21 > 1e-9 * abs(close) AND calm",
    "credit_spread_call": "close < upper_band AND rsi < 60 AND ema9 - ema21 < -1e-9 * abs(close) AND calm",
    "iron_condor": f"{_W} < atr * 2 AND calm",
    "straddle": f"{_W} > atr * 2 AND {_NEUTRAL}",
    "strangle": f"{_W} > atr * 2 AND {_NEUTRAL}",
    "butterfly": f"{_W} < atr AND {_NEUTRAL}",
}


def _flag(name):
    return f"CASE WHEN {_SIGNALS[name]} THEN 1 ELSE 0 END AS {name}"


def _signal_ctes(source):
    return {
        **frame_ctes(source),
        "ca": f"SELECT *, {_CALM} AS calm FROM fr",
        "sg": f"SELECT series, ts, close, {', '.join(_flag(s) for s in STRATEGIES)} FROM ca",
    }


_SG = ctes("bars_h", recursive=True, **_signal_ctes("bars_h"))


def _signal_query(name):
    @query(name, _SG + f"SELECT series, ts, {name} FROM sg")
    def q(spark, sf):
        return signals_from_bars(I.bars_h(spark, sf), I.H).select("series", "ts", name)

    return q


for _name in STRATEGIES[:4]:
    _signal_query(_name)


_BAND = {
    **indicator_ctes("bars_h"),
    "fr": "SELECT series, ts, close, rsi, coalesce(atr, 0) AS atr, coalesce(upper_band, 0) AS upper_band, coalesce(lower_band, 0) AS lower_band FROM ind",
    "ca": f"SELECT *, {_CALM} AS calm FROM fr",
}


def _band_query(name):
    @query(name, ctes("bars_h", **_BAND) + f"SELECT series, ts, {_flag(name)} FROM ca")
    def q(spark, sf):
        return band_signals_from_bars(I.bars_h(spark, sf), I.H).select("series", "ts", name)

    return q


for _name in STRATEGIES[4:]:
    _band_query(_name)


@query("trade_signals", _SG + f"SELECT series, ts, {', '.join(STRATEGIES)} FROM sg")
def q_trade_signals(spark, sf):
    return trade_signals(frame(spark, sf), I.H)


_COUNTS = " UNION ALL ".join(
    f"SELECT series, count(*) AS bars, '{s}' AS strategy, sum({s})::BIGINT AS fired FROM sg GROUP BY series" for s in STRATEGIES
)


@query("signal_counts", _SG + _COUNTS)
def q_signal_counts(spark, sf):
    return signal_counts(signals_from_bars(I.bars_h(spark, sf), I.H))


@query("signal_counts_daily", ctes("bars_d", recursive=True, **_signal_ctes("bars_d")) + _COUNTS)
def q_signal_counts_daily(spark, sf):
    return signal_counts(signals_from_bars(I.bars_d(spark, sf), I.D))


# -- backtest on predictions -----------------------------------------------------

MODELS = ["m1", "m2", "m3", "m4"]
_FT = {
    "p": f"""SELECT series, ts, close, lead(close, 1) OVER {over()} AS open_price, lead(close, 3) OVER {over()} AS close_price,
        lag(close, 1) OVER {over()} AS m1, {full('avg', 'close', 5)} AS m2, {full('avg', 'close', 20)} AS m3,
        lag(close, 3) OVER {over()} AS m4 FROM bars_d""",
    "ft": """SELECT *, 0.4 * m1 + 0.3 * m2 + 0.3 * m4 AS predicted, (m1 + m2 + m3 + m4) / 4 AS mm
        FROM p WHERE close_price IS NOT NULL AND m3 IS NOT NULL""",
    "sd": "SELECT *, sqrt(((m1 - mm) * (m1 - mm) + (m2 - mm) * (m2 - mm) + (m3 - mm) * (m3 - mm) + (m4 - mm) * (m4 - mm)) / 4) AS sd FROM ft",
    "bt": """SELECT *, predicted - 1.28 * sd AS low, predicted + 1.28 * sd AS high FROM sd""",
}


def _backtest(spark, sf):
    bars = I.bars_d(spark, sf).select("series", "ts", "close")
    z = zones.enter(bars, I.D, before=20, after=3)
    w = zones.window(I.D)
    z = z.withColumns(
        {
            "open_price": F.lead("close", 1).over(w),
            "close_price": F.lead("close", 3).over(w),
            "m1": F.lag("close", 1).over(w),
            "m2": sma("close", w, 5),
            "m3": sma("close", w, 20),
            "m4": F.lag("close", 3).over(w),
        }
    )
    rows = zones.leave(z).na.drop(subset=["close_price", *MODELS])
    rows = rows.withColumn("predicted", weighted_combine({"m1": 0.4, "m2": 0.3, "m4": 0.3}))
    rows = rows.withColumns(T.ensemble_band("predicted", MODELS))
    return rows.withColumn("success", T.trade_success())


@query(
    "forward_trades",
    ctes(
        "bars_d",
        p=f"SELECT series, ts, close, lead(close, 1) OVER {over()} AS open_price, lead(close, 3) OVER {over()} AS close_price FROM bars_d",
    )
    + "SELECT series, ts, close, open_price, close_price FROM p WHERE close_price IS NOT NULL",
)
def q_forward_trades(spark, sf):
    return T.forward_trades(I.bars_d(spark, sf).select("series", "ts", "close"), I.D)


@query("ensemble_band", ctes("bars_d", **_FT) + f"SELECT series, ts, {rnd('predicted', 'low', 'high', places=4)} FROM bt")
def q_band(spark, sf):
    return rounded(_backtest(spark, sf).select("series", "ts", "predicted", "low", "high"), 4)


@query("trade_success", ctes("bars_d", **_FT) + "SELECT series, ts, close_price BETWEEN low AND high AS success FROM bt")
def q_success(spark, sf):
    return _backtest(spark, sf).select("series", "ts", "success")


@query(
    "backtest_metrics",
    ctes("bars_d", **_FT)
    + """SELECT series, round(avg(abs(close_price - predicted)), 4) AS mae,
        round(sqrt(avg((close_price - predicted) * (close_price - predicted))), 4) AS rmse,
        round(avg((close_price BETWEEN low AND high)::INTEGER), 4) AS win_share, count(*) AS trades FROM bt GROUP BY series""",
)
def q_backtest_metrics(spark, sf):
    return rounded(T.backtest_metrics(_backtest(spark, sf)), 4)


_B5 = " UNION ALL ".join(
    f"SELECT '{tf}' AS timeframe, '{h}' AS horizon, close AS predicted, lead(close, {h}) OVER {over()} AS actual FROM {source}"
    for tf, source in (("5m", "bars_5m_all"), ("15m", "bars_15m_all"), ("1h", "bars_h_all"), ("1d", "bars_d_all"))
    for h in (12, 24, 36, 48, 72, 96)
)


@query(
    "multi_horizon_backtest",
    ctes(
        "bars_5m_all",
        "bars_15m_all",
        "bars_h_all",
        "bars_d_all",
        a=_B5,
        r="SELECT * FROM a WHERE actual IS NOT NULL",
        c="SELECT timeframe, horizon, avg(predicted) - 0.75 * stddev_pop(predicted) AS lo, avg(predicted) + 0.75 * stddev_pop(predicted) AS hi FROM r GROUP BY 1, 2",
    )
    + """SELECT timeframe, horizon, round(avg(abs(actual - predicted)), 6) AS mae, round(sqrt(avg((actual - predicted) * (actual - predicted))), 6) AS rmse,
        round(avg((actual BETWEEN lo AND hi)::INTEGER), 6) AS coverage, count(*) AS n FROM r JOIN c USING (timeframe, horizon) GROUP BY 1, 2""",
)
def q_multi_horizon(spark, sf):
    out = None
    inputs = {"5m": (I.bars_5m_all, Order(300)), "15m": (I.bars_15m_all, I.Q), "1h": (I.bars_h_all, I.H), "1d": (I.bars_d_all, I.D)}
    for timeframe, (read, order) in inputs.items():
        bars = read(spark, sf)
        rows = bars.select(F.lit(timeframe).alias("timeframe"), "series", "ts", "close")
        part = T.multi_horizon_backtest(rows, order, (12, 24, 36, 48, 72, 96))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


# -- simulated option trades -------------------------------------------------------


def option_trades(spark, sf):
    """One trade per daily bar: type and confidence by key, prices by row."""
    bars = I.bars_d(spark, sf).select("series", "ts", "close")
    h = key_hash(series_key("series", "ts"))
    z = zones.enter(bars, I.D, before=20, after=3)
    w = zones.window(I.D)
    z = z.withColumns(
        {
            "open_price": F.lead("close", 1).over(w),
            "close_price": F.lead("close", 3).over(w),
            "volatility": F.coalesce(full_frame(F.stddev_samp, "close", w, 20), F.lit(0.0)),
        }
    )
    rows = zones.leave(z).where(F.col("close_price").isNotNull())
    kinds = F.array(*[F.lit(t) for t in (*T.TRADE_TYPES, "calendar")])
    return rows.select(
        "series",
        F.element_at(kinds, ((h / 100).cast("long") % 5 + 1).cast("int")).alias("trade_type"),
        F.col("ts").alias("open_date"),
        "open_price",
        "close_price",
        F.col("close").alias("strike"),
        (F.col("close") * 0.02).alias("premium_received"),
        (F.col("close") * 0.01).alias("premium_paid"),
        "volatility",
        F.lit(0.5).alias("time_decay"),
        (F.col("close") * 0.05).alias("max_profit"),
        (F.col("close") * 0.03).alias("max_loss"),
        (h % 100 / 100).alias("confidence"),
        F.lit(2).alias("evaluation_days"),
        F.lit(1.5).alias("risk_reward"),
    )


_KIND = "['credit_spread', 'debit_spread', 'iron_condor', 'straddle', 'calendar']"
_OT = {
    "tp": f"""SELECT series, ts, close AS strike, lead(close, 1) OVER {over()} AS open_price, lead(close, 3) OVER {over()} AS close_price,
        coalesce({full('stddev_samp', 'close', 20)}, 0) AS volatility, {HASH.format(KEY)} AS h FROM bars_d""",
    "tr": f"""SELECT series, ts AS open_date, {_KIND}[((h // 100) % 5 + 1)::INTEGER] AS trade_type, strike, open_price, close_price, volatility,
        strike * 0.02 AS recv, strike * 0.01 AS paid, strike * 0.05 AS max_profit, strike * 0.03 AS max_loss, (h % 100) / 100 AS confidence
        FROM tp WHERE close_price IS NOT NULL""",
    "pay": """SELECT *, CASE trade_type
        WHEN 'credit_spread' THEN CASE WHEN close_price > strike THEN -max_loss ELSE recv - paid END
        WHEN 'debit_spread' THEN CASE WHEN close_price < strike THEN max_profit - paid ELSE -paid END
        WHEN 'iron_condor' THEN CASE WHEN strike < close_price AND close_price < strike + 2 THEN recv - paid ELSE -max_loss END
        WHEN 'straddle' THEN CASE WHEN abs(close_price - strike) > volatility * 0.5 THEN recv - paid ELSE -paid END
        ELSE 0 END AS payoff FROM tr""",
    "pl": "SELECT *, CASE WHEN payoff < 0 AND confidence > 0.5 THEN payoff + (0.9 * recv - paid) ELSE payoff END AS pl FROM pay",
}


@query("option_payoff", ctes("bars_d", **_OT) + f"SELECT series, open_date, trade_type, {rnd('payoff', places=4)} FROM pay")
def q_payoff(spark, sf):
    rows = option_trades(spark, sf).withColumn("payoff", T.option_payoff())
    return rounded(rows.select("series", "open_date", "trade_type", "payoff"), 4)


@query("roll_adjustment", ctes("bars_d", **_OT) + f"SELECT series, open_date, {rnd('pl AS profit_loss', places=4)} FROM pl")
def q_roll(spark, sf):
    return rounded(T.simulate_trades(option_trades(spark, sf)).select("series", "open_date", "profit_loss"), 4)


@query("trade_outcome", ctes("bars_d", **_OT) + "SELECT series, open_date, pl > 0 AS successful FROM pl")
def q_outcome(spark, sf):
    return T.simulate_trades(option_trades(spark, sf)).select("series", "open_date", "successful")


@query(
    "trade_dates",
    ctes("bars_d", **_OT)
    + f"""SELECT series, trade_type, open_price AS strike_price_open, close_price AS strike_price_close, open_date,
        open_date + INTERVAL '2 days' AS expiry_date, 2 AS days_evaluated, 1.5::DOUBLE AS risk_reward, {rnd('pl AS profit_loss', places=4)},
        open_price AS price_open, close_price AS price_close, pl > 0 AS successful_trade, confidence AS prediction_confidence FROM pl""",
)
def q_trade_dates(spark, sf):
    return rounded(T.trade_summary(T.simulate_trades(option_trades(spark, sf))), 4)


@query(
    "risk_management",
    ctes("bars_d", **_OT)
    + """SELECT series, open_date, round(CASE WHEN pl <= -2000 THEN -2000 WHEN pl >= 3000 THEN 3000 ELSE pl END, 4) + 0.0 AS managed_profit_loss,
        CASE WHEN pl <= -2000 THEN false WHEN pl >= 3000 THEN true ELSE pl > 0 END AS managed_outcome FROM pl""",
)
def q_risk(spark, sf):
    rows = T.simulate_trades(option_trades(spark, sf)).withColumns(T.risk_management(-2000, 3000))
    return rounded(rows.select("series", "open_date", "managed_profit_loss", "managed_outcome"), 4)


_SUM = "round(sum(pl), 2) AS total_pl, round(avg(pl), 4) AS mean_pl, round(avg((pl > 0)::INTEGER), 6) AS win_rate, count(*) AS trades"


def _summary(df):
    return df.withColumns(
        {"total_pl": F.round("total_pl", 2), "mean_pl": F.round("mean_pl", 4), "win_rate": F.round("win_rate", 6)}
    )


@query("strategy_summary", ctes("bars_d", **_OT) + f"SELECT trade_type, {_SUM} FROM pl GROUP BY trade_type")
def q_summary(spark, sf):
    return _summary(T.strategy_summary(T.simulate_trades(option_trades(spark, sf))))


@query(
    "strategy_summary_by_year",
    ctes("bars_d", **_OT)
    + f"SELECT trade_type, year(open_date)::INTEGER AS year, {_SUM} FROM pl GROUP BY ROLLUP (trade_type, year(open_date))",
)
def q_summary_year(spark, sf):
    return _summary(T.strategy_summary(T.simulate_trades(option_trades(spark, sf)), by_year=True))


_FIRED = " UNION ALL ".join(f"SELECT series, ts, '{s}' AS strategy FROM sg WHERE {s} = 1" for s in STRATEGIES)


@query(
    "signal_trades",
    ctes(
        "bars_d",
        recursive=True,
        **_signal_ctes("bars_d"),
        fi=_FIRED,
        pr=f"SELECT series, ts, close, lead(close, 1) OVER {over()} AS open_price, lead(close, 3) OVER {over()} AS close_price FROM bars_d",
    )
    + "SELECT series, ts, strategy, close, open_price, close_price FROM fi JOIN pr USING (series, ts) WHERE close_price IS NOT NULL",
)
def q_signal_trades(spark, sf):
    bars = I.bars_d(spark, sf)
    return T.signal_trades(signals_from_bars(bars, I.D), bars, I.D)
