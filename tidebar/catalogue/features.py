"""Queries of features, targets, sequences and splits (F1–F16, V1–V3, V6, V7)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidebar.catalogue import query
from tidebar.catalogue.cleaning import frame
from tidebar.catalogue.common import HASH, KEY, ctes, ewm_sql, frame_ctes, full, indicator_ctes, over, rnd, rounded
from tidebar.functions.scalars import series_key
from tidebar.operators import clean as C
from tidebar.operators import evaluate as E
from tidebar.operators import features as X
from tidebar.operators import indicators as ind
from tidebar.operators import splits as V
from tidebar.operators.ewm import ewm
from tidebar.operators.models import vectorise
from tidebar.plans import inputs as I
from tidebar.plans import zones
from tidebar.plans.zones import Order
from tidebar.session import stage_once

_BWD = "(PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_LAGS = [f"lag(close, {k}) OVER {over()} AS close_lag_{k}" for k in (1, 2, 3)]
_MEANS = [f"{full('avg', 'close', n)} AS close_ma_{n}" for n in (5, 10, 15)]
LAG_NAMES = [f"close_lag_{k}" for k in (1, 2, 3)]
MEAN_NAMES = [f"close_ma_{n}" for n in (5, 10, 15)]
_LM = {"lm": f"SELECT series, ts, close, {', '.join(_LAGS + _MEANS)} FROM bars_h"}


@query("lag_features", ctes("bars_h", **_LM) + f"SELECT series, ts, {', '.join(LAG_NAMES)} FROM lm")
def q_lags(spark, sf):
    z = zones.enter(I.bars_h(spark, sf), I.H, before=3)
    z = z.withColumns(X.lag_features("close", zones.window(I.H)))
    return zones.leave(z).select("series", "ts", *LAG_NAMES)


@query("moving_averages", ctes("bars_h", **_LM) + f"SELECT series, ts, {rnd(*MEAN_NAMES)} FROM lm")
def q_means(spark, sf):
    return rounded(X.lags_and_averages(I.bars_h(spark, sf), I.H).select("series", "ts", *MEAN_NAMES))


@query(
    "backfilled_features",
    ctes(
        "bars_h",
        **_LM,
        b="SELECT series, ts, "
        + ", ".join(f"coalesce(first_value({c} IGNORE NULLS) OVER {_BWD}, 0) AS {c}" for c in LAG_NAMES + MEAN_NAMES)
        + " FROM lm",
    )
    + f"SELECT series, ts, {rnd(*LAG_NAMES, *MEAN_NAMES)} FROM b",
)
def q_backfilled(spark, sf):
    df = X.backfilled_features(I.bars_h(spark, sf), I.H)
    return rounded(df.select("series", "ts", *LAG_NAMES, *MEAN_NAMES))


@query(
    "calendar_features",
    ctes("bars_15m_all")
    + "SELECT series, ts, (isodow(ts) - 1)::INTEGER AS day_of_week, hour(ts)::INTEGER AS hour, minute(ts)::INTEGER AS minute FROM bars_15m_all",
)
def q_calendar(spark, sf):
    return I.bars_15m_all(spark, sf).select("series", "ts", *[c.alias(n) for n, c in X.calendar_features().items()])


_CYC = "sin(2 * pi() * hour(ts) / 24) AS hour_sin|cos(2 * pi() * hour(ts) / 24) AS hour_cos|sin(2 * pi() * minute(ts) / 60) AS minute_sin|cos(2 * pi() * minute(ts) / 60) AS minute_cos".split("|")


@query("cyclic_time", ctes("bars_15m_all") + f"SELECT series, ts, {rnd(*_CYC, places=9)} FROM bars_15m_all")
def q_cyclic(spark, sf):
    return rounded(I.bars_15m_all(spark, sf).select("series", "ts", *[c.alias(n) for n, c in X.cyclic_time().items()]), 9)


_SCALED = """SELECT b.*, lo, hi, CASE WHEN hi = lo THEN 0 ELSE (close - lo) / (hi - lo) END AS close_scaled
    FROM bars_h b JOIN (SELECT series, min(close) AS lo, max(close) AS hi FROM bars_h GROUP BY 1) m ON m.series = b.series"""


@query("minmax_scale", ctes("bars_h", sc=_SCALED) + f"SELECT series, ts, {rnd('close_scaled', places=9)} FROM sc")
def q_minmax(spark, sf):
    return rounded(X.minmax_scale(I.bars_h(spark, sf), ["close"]).select("series", "ts", "close_scaled"), 9)


@query("inverse_scale", ctes("bars_h") + f"SELECT series, ts, {rnd('close AS restored')} FROM bars_h")
def q_inverse(spark, sf):
    bars = I.bars_h(spark, sf)
    fitted = X.scaler(bars, ["close"])
    scaled = X.minmax_scale(bars, ["close"], fitted).select("series", "ts", "close_scaled")
    out = X.inverse_scale(scaled, "close_scaled", "close", fitted, "restored")
    return rounded(out.select("series", "ts", "restored"))


@query(
    "forward_target",
    ctes("bars_h", t=f"SELECT series, ts, close, lead(close, 24) OVER {over()} AS target FROM bars_h")
    + "SELECT series, ts, close, target FROM t WHERE target IS NOT NULL",
)
def q_target(spark, sf):
    return X.forward_target(I.bars_h(spark, sf).select("series", "ts", "close"), I.H, 24)


def _horizons_sql(horizons, source="bars_h"):
    return " UNION ALL ".join(
        f"SELECT series, ts, close, '{label}' AS horizon, {steps} AS steps, lead(close, {steps}) OVER {over()} AS target FROM {source}"
        for label, steps in horizons.items()
    )


_H6 = {str(h): h for h in X.HORIZON_ROWS}


@query(
    "multi_horizon_targets",
    ctes("bars_h", t=_horizons_sql(_H6)) + "SELECT series, ts, close, horizon, steps, target FROM t WHERE target IS NOT NULL",
)
def q_horizons(spark, sf):
    return X.multi_horizon_targets(I.bars_h(spark, sf).select("series", "ts", "close"), I.H, X.HORIZON_ROWS)


@query(
    "multi_horizon_targets_clock",
    ctes("bars_15m_all", t=_horizons_sql(X.HORIZONS_CLOCK, "bars_15m_all"))
    + "SELECT series, ts, close, horizon, steps, target FROM t WHERE target IS NOT NULL",
)
def q_horizons_clock(spark, sf):
    rows = I.bars_15m_all(spark, sf).select("series", "ts", "close")
    return X.multi_horizon_targets(rows, I.Q, X.HORIZONS_CLOCK)


# -- sequences -----------------------------------------------------------------

# Values are compared as whole millionths, joined in order and hashed.
_SEQ_FEATURES = ("close", "high", "low", "open", "volume")


def _digest(array):
    text = F.array_join(F.transform(array, lambda x: F.round(x * 1e6).cast("long").cast("string")), ",")
    return F.md5(text)


def _scale_sql(source, columns):
    pairs = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in columns)
    scaled = ", ".join(
        f"CASE WHEN hi_{c} = lo_{c} THEN 0 ELSE (b.{c} - lo_{c}) / (hi_{c} - lo_{c}) END AS s_{c}" for c in columns
    )
    return f"SELECT b.series, b.ts, {scaled} FROM {source} b JOIN (SELECT series, {pairs} FROM {source} GROUP BY 1) m ON m.series = b.series"


def _seq_sql(source, steps, length=48, features=_SEQ_FEATURES):
    texts = " || ',' || ".join(f"round(s_{c} * 1e6)::BIGINT::VARCHAR" for c in features)
    w = f"(PARTITION BY series ORDER BY ts ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW)"
    return ctes(
        source,
        sc=_scale_sql(source, features),
        t=f"SELECT *, {texts} AS txt FROM sc",
        q=f"""SELECT series, ts, list(txt) OVER {w} AS seq, lead(s_close, {steps}) OVER {over()} AS target,
            row_number() OVER {over()} AS rn FROM t""",
    ) + f"""SELECT series, ts, len(seq)::INTEGER AS steps, md5(array_to_string(seq, ',')) AS digest, round(target, 9) AS target
        FROM q WHERE rn >= {length} AND target IS NOT NULL"""


def _digested(df, features=_SEQ_FEATURES):
    flat = X.flat_vector("sequence", features)
    return df.select(
        "series", "ts", F.size("sequence").alias("steps"), _digest(flat).alias("digest"), F.round("target", 9).alias("target")
    )


@query("sequences", _seq_sql("bars_15m_all", 26))
def q_sequences(spark, sf):
    return _digested(X.sequences(I.bars_15m_all(spark, sf), I.Q, _SEQ_FEATURES))


@query("sequences_next", _seq_sql("bars_15m_all", 1))
def q_sequences_next(spark, sf):
    return _digested(X.sequences_next(I.bars_15m_all(spark, sf), I.Q, _SEQ_FEATURES))


@query(
    "sequences_alternating",
    ctes(
        "bars_15m_all",
        sc=_scale_sql("bars_15m_all", ("close",)),
        q=f"""SELECT series, ts, row_number() OVER {over()} - 1 AS start, count(*) OVER (PARTITION BY series) AS n,
            list(round(s_close * 1e6)::BIGINT) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND 13 FOLLOWING) AS ahead,
            lead(s_close, 22) OVER {over()} AS t13, lead(s_close, 23) OVER {over()} AS t14 FROM sc""",
        r="SELECT *, CASE WHEN start = 0 OR start % 2 = 1 THEN 13 ELSE 14 END AS seq_len FROM q WHERE start < n - 24",
    )
    + """SELECT series, start, seq_len::INTEGER AS seq_len,
        md5(array_to_string(CASE WHEN seq_len = 13 THEN list_concat(ahead[1:13], [0]) ELSE ahead END, ',')) AS digest,
        round(CASE WHEN seq_len = 13 THEN t13 ELSE t14 END, 9) AS target FROM r""",
)
def q_alternating(spark, sf):
    df = X.sequences_alternating(X.minmax_scale(I.bars_15m_all(spark, sf), ["close"]), I.Q)
    return df.select("series", "start", "seq_len", _digest(F.col("sequence")).alias("digest"), F.round("target", 9).alias("target"))


@query(
    "last_timestep",
    ctes(
        "bars_15m_all",
        sc=_scale_sql("bars_15m_all", _SEQ_FEATURES),
        q=f"SELECT *, row_number() OVER {over()} AS rn, lead(s_close, 26) OVER {over()} AS t FROM sc",
    )
    + f"SELECT series, ts, {rnd(*(f's_{c} AS {c}' for c in _SEQ_FEATURES), places=9)} FROM q WHERE rn >= 48 AND t IS NOT NULL",
)
def q_last_timestep(spark, sf):
    df = X.sequences(I.bars_15m_all(spark, sf), I.Q, _SEQ_FEATURES)
    return rounded(df.select("series", "ts", X.last_timestep().alias("s")).select("series", "ts", "s.*"), 9)


@query(
    "vectorise",
    ctes("bars_h", **_LM)
    + " UNION ALL ".join(
        f"SELECT series, ts, {i} AS pos, {rnd(f'{c} AS value')} FROM lm WHERE close_ma_15 IS NOT NULL"
        for i, c in enumerate(LAG_NAMES + MEAN_NAMES)
    ),
)
def q_vectorise(spark, sf):
    rows = X.lags_and_averages(I.bars_h(spark, sf), I.H).na.drop()
    vectors = vectorise([*LAG_NAMES, *MEAN_NAMES]).transform(rows)
    return rounded(vectors.select("series", "ts", F.posexplode(vector_to_array("features")).alias("pos", "value")))


_TREND = ewm_sql("bars_d", {"ema9": ("close", 9), "ema21": ("close", 21)})


@query(
    "binary_trend_label",
    ctes("bars_d", recursive=True, **_TREND)
    + "SELECT n.series, n.ts, (round(ema9, 4) > round(ema21, 4))::INTEGER AS label FROM ew JOIN num n USING (series, rn)",
)
def q_trend_label(spark, sf):
    df = rounded(ewm(I.bars_d(spark, sf), I.D, {"ema9": ("close", 9), "ema21": ("close", 21)}), 4)
    return df.select("series", "ts", X.binary_trend_label().alias("label"))


_NUM = ("open", "high", "low", "target", "rsi", "atr", "adx", "upper_band", "lower_band", "hour_sin", "hour_cos", "minute_sin", "minute_cos")


def _combined_sql():
    sources = {"f": ("5m", "bars_5m_all"), "q": ("15m", "bars_15m_all"), "h": ("1h", "bars_h"), "d": ("1d", "bars_d_all")}

    def chain(source, p):
        c = indicator_ctes(source)
        out = {}
        for name, body in c.items():
            for other in c:
                body = body.replace(f" FROM {other}", f" FROM {p}_{other}")
            out[f"{p}_{name}"] = body
        return out

    def part(p, label, source):
        cyc = ", ".join(_CYC)
        return f"""SELECT '{label}' AS timeframe, series, ts, open, high, low, close AS target, volume, rsi, coalesce(atr, 0) AS atr, adx,
            coalesce(upper_band, 0) AS upper_band, coalesce(lower_band, 0) AS lower_band,
            (isodow(ts) - 1)::INTEGER AS day_of_week, hour(ts)::INTEGER AS hour, minute(ts)::INTEGER AS minute, {cyc},
            CASE WHEN close - prev_close > 0 THEN 1 WHEN close - prev_close < 0 THEN -1 ELSE 0 END AS impulse_color FROM {p}_ind"""

    u = " UNION ALL ".join(part(p, *of) for p, of in sources.items())
    chains = {k: v for p, (_, source) in sources.items() for k, v in chain(source, p).items()}
    return ctes(*(source for _, source in sources.values()), **chains, u=u) + (
        f"SELECT timeframe, series, ts, {rnd(*_NUM)}, volume, day_of_week, hour, minute, impulse_color FROM u"
    )


def _training_part(bars, order):
    """Band, RSI, ATR and ADX columns with the colour of the last change."""
    z = zones.enter(bars, order, before=ind.CONTEXT)
    w = zones.window(order)
    z = ind.with_directional_movement(ind.with_true_range(ind.with_rsi(z, w), w), w)
    z = ind.with_adx(ind.with_directional_index(ind.bollinger(ind.with_atr(z, w), w), w), w)
    z = z.withColumn("impulse_color", ind.simple_impulse("close", w))
    z = C.fill_zero(z, ["upper_band", "lower_band", "atr"])
    return zones.leave(z).select(
        "series", "ts", "open", "high", "low", "close", "volume", "rsi", "atr", "adx", "upper_band", "lower_band", "impulse_color"
    )


@query("combined_training_frame", _combined_sql())
def q_combined(spark, sf):
    inputs = {"5m": (I.bars_5m_all, Order(300)), "15m": (I.bars_15m_all, I.Q), "1h": (I.bars_h, I.H), "1d": (I.bars_d_all, I.D)}
    frames = {
        k: stage_once(spark, f"{sf}/training_{k}", lambda read=read, order=order: _training_part(read(spark, sf), order))
        for k, (read, order) in inputs.items()
    }
    return rounded(X.combined_training_frame(frames, {k: order for k, (_, order) in inputs.items()}))


# -- splits and validation -----------------------------------------------------


@query(
    "chronological_split",
    ctes("bars_h", r=f"SELECT series, ts, row_number() OVER {over()} AS rn, count(*) OVER (PARTITION BY series) AS n FROM bars_h")
    + "SELECT series, ts, CASE WHEN rn <= floor(0.75 * n) THEN 'train' ELSE 'test' END AS split FROM r",
)
def q_chronological(spark, sf):
    return V.chronological_split(I.bars_h(spark, sf).select("series", "ts"), I.H)


@query(
    "random_split",
    ctes("bars_h") + f"SELECT series, ts, CASE WHEN {HASH.format(KEY)} % 100 < 20 THEN 'test' ELSE 'train' END AS split FROM bars_h",
)
def q_random(spark, sf):
    return I.bars_h(spark, sf).select("series", "ts", V.random_split(series_key("series", "ts")).alias("split"))


@query("kfold", ctes("bars_h") + f"SELECT series, ts, ({HASH.format(KEY)} % 5)::INTEGER AS fold FROM bars_h")
def q_kfold(spark, sf):
    return I.bars_h(spark, sf).select("series", "ts", V.kfold(series_key("series", "ts")).alias("fold"))


_EXPAND = "(PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_WF = {
    "b": f"SELECT series, ts, close, row_number() OVER {over()} - 1 AS pos, count(*) OVER (PARTITION BY series) AS n FROM bars_15m_all",
    "l": f"SELECT *, regr_slope(close, pos) OVER {_EXPAND} AS k, regr_intercept(close, pos) OVER {_EXPAND} AS m FROM b",
}
_STEPS = "(VALUES " + ", ".join(f"('{a}', {s})" for a, s in X.HORIZONS_CLOCK.items()) + ") h(horizon, steps)"


_WF_ROWS = f"""SELECT l.series, l.ts, l.pos AS origin, h.horizon, f.close AS actual, l.m + l.k * (l.pos + h.steps) AS predicted
    FROM l, {_STEPS} JOIN b f ON f.series = l.series AND f.pos = l.pos + h.steps WHERE l.pos % 15 = 0 AND l.pos >= 47"""


@query(
    "walk_forward",
    ctes("bars_15m_all", **_WF, w=_WF_ROWS) + f"SELECT series, ts, origin, horizon, actual, {rnd('predicted')} FROM w",
)
def q_walk_forward(spark, sf):
    return rounded(V.walk_forward(I.bars_15m_all(spark, sf), I.Q))


@query(
    "walk_forward_metrics",
    ctes("bars_15m_all", **_WF, w=_WF_ROWS)
    + """SELECT series, horizon, round(avg(abs(actual - predicted)), 6) AS mae,
        round(sqrt(avg((actual - predicted) * (actual - predicted))), 6) AS rmse, count(*) AS n FROM w GROUP BY 1, 2""",
)
def q_walk_forward_metrics(spark, sf):
    rows = V.walk_forward(I.bars_15m_all(spark, sf), I.Q)
    e = E.error_metrics()
    return rounded(
        rows.groupBy("series", "horizon").agg(e["mae"].alias("mae"), e["rmse"].alias("rmse"), F.count(F.lit(1)).alias("n"))
    )


# each row with the days whose window holds it: an equi-join on the day follows
_ED_DAYS = f"""SELECT b.series, b.pos, b.n, h.horizon, h.steps,
        unnest(range(greatest(1, (b.pos - h.steps + 96 * 8) // 96 - 7), b.pos // 96 + 1)) AS day
    FROM b, {_STEPS} WHERE h.steps >= 48"""
_ED = """SELECT d.series, d.day, d.horizon, d.pos AS row, f.close AS actual, l.m + l.k * (d.pos + d.steps) AS predicted
    FROM dd d JOIN l ON l.series = d.series AND l.pos = d.day * 96 - 1
    JOIN b f ON f.series = d.series AND f.pos = d.pos + d.steps
    WHERE d.day * 96 + d.steps < d.n"""


@query(
    "expanding_daily",
    ctes("bars_15m_all", **_WF, dd=_ED_DAYS, w=_ED)
    + """SELECT series, day, horizon, round(avg(abs(actual - predicted)), 6) AS mae,
        round(sqrt(avg((actual - predicted) * (actual - predicted))), 6) AS rmse, count(*) AS n FROM w GROUP BY 1, 2, 3""",
)
def q_expanding(spark, sf):
    rows = V.expanding_daily(I.bars_15m_all(spark, sf), I.Q)
    e = E.error_metrics()
    return rounded(
        rows.groupBy("series", "day", "horizon").agg(
            e["mae"].alias("mae"), e["rmse"].alias("rmse"), F.count(F.lit(1)).alias("n")
        )
    )


# -- validation with features: level, last change, distance from the mean of 20 -

_CHANGES = {
    "level": lambda w: F.col("close"),
    "change": lambda w: F.col("close") - F.lag("close").over(w),
    "distance": lambda w: F.col("close") - ind.full(F.avg, "close", w, 20),
}
_FEATURE_CTES = {
    "b": f"""SELECT series, ts, close, row_number() OVER {over()} - 1 AS pos, count(*) OVER (PARTITION BY series) AS n, close AS x1,
        close - lag(close) OVER {over()} AS x2, close - ({full('avg', 'close', 20)}) AS x3 FROM bars_15m_all""",
    # rows without all features train nothing
    "p": f"""SELECT b.*, h.horizon, h.steps, CASE WHEN g.x3 IS NOT NULL THEN b.close END AS y,
            CASE WHEN g.x3 IS NOT NULL THEN g.x1 END AS t1, CASE WHEN g.x3 IS NOT NULL THEN g.x2 END AS t2, g.x3 AS t3
        FROM b CROSS JOIN {_STEPS} LEFT JOIN b g ON g.series = b.series AND g.pos = b.pos - h.steps""",
}
_RUN = "(PARTITION BY series, horizon ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_FEATURE_CTES |= {
    "mo": "SELECT *, count(t1) OVER r AS k, avg(y) OVER r AS my, "
    + ", ".join(f"avg(t{i}) OVER r AS m{i}, covar_pop(t{i}, y) OVER r AS v{i}" for i in (1, 2, 3))
    + ", "
    + ", ".join(f"covar_pop(t{i}, t{j}) OVER r AS c{i}{j}" for i in (1, 2, 3) for j in range(i, 4))
    + f" FROM p WINDOW r AS {_RUN}",
    # elimination of the three normal equations
    "e1": "SELECT *, c22 - c12 * c12 / c11 AS d22, c23 - c12 * c13 / c11 AS d23, c33 - c13 * c13 / c11 AS d33, v2 - c12 * v1 / c11 AS w2, v3 - c13 * v1 / c11 AS w3 FROM mo WHERE k > 3",
    "e2": "SELECT *, (w3 - d23 * w2 / d22) / (d33 - d23 * d23 / d22) AS b3 FROM e1",
    "e3": "SELECT *, (w2 - d23 * b3) / d22 AS b2 FROM e2",
    "fit": "SELECT *, (v1 - c12 * b2 - c13 * b3) / c11 AS b1, my - (v1 - c12 * b2 - c13 * b3) / c11 * m1 - b2 * m2 - b3 * m3 AS b0 FROM e3",
}
_FEATURE_ORIGINS = """SELECT o.series, o.ts, o.pos AS origin, o.horizon, f.close AS actual, q.b0 + q.b1 * o.x1 + q.b2 * o.x2 + q.b3 * o.x3 AS predicted
    FROM p o JOIN b f ON f.series = o.series AND f.pos = o.pos + o.steps
    LEFT JOIN fit q ON q.series = o.series AND q.horizon = o.horizon AND q.pos = o.pos WHERE o.pos % 15 = 0 AND o.pos >= 47"""
_FEATURE_DAYS = """SELECT d.series, d.day, d.horizon, d.pos AS row, f.close AS actual, q.b0 + q.b1 * o.x1 + q.b2 * o.x2 + q.b3 * o.x3 AS predicted
    FROM dd d JOIN b o ON o.series = d.series AND o.pos = d.pos JOIN b f ON f.series = d.series AND f.pos = d.pos + d.steps
    LEFT JOIN fit q ON q.series = d.series AND q.horizon = d.horizon AND q.pos = d.day * 96 - 1
    WHERE d.day * 96 + d.steps < d.n AND d.day * 96 <= d.n"""
_FEATURE_ERRORS = """round(avg(abs(actual - predicted)), 6) AS mae,
        round(sqrt(avg((actual - predicted) * (actual - predicted))), 6) AS rmse, count(*) AS n"""


@query(
    "walk_forward_features",
    ctes("bars_15m_all", **_FEATURE_CTES, w=_FEATURE_ORIGINS) + f"SELECT series, ts, origin, horizon, actual, {rnd('predicted')} FROM w",
)
def q_walk_forward_features(spark, sf):
    return rounded(V.walk_forward_features(I.bars_15m_all(spark, sf), I.Q, _CHANGES, 20))


@query(
    "walk_forward_features_metrics",
    ctes("bars_15m_all", **_FEATURE_CTES, w=_FEATURE_ORIGINS) + f"SELECT series, horizon, {_FEATURE_ERRORS} FROM w GROUP BY 1, 2",
)
def q_walk_forward_features_metrics(spark, sf):
    rows = V.walk_forward_features(I.bars_15m_all(spark, sf), I.Q, _CHANGES, 20)
    e = E.error_metrics()
    return rounded(
        rows.groupBy("series", "horizon").agg(e["mae"].alias("mae"), e["rmse"].alias("rmse"), F.count(F.lit(1)).alias("n"))
    )


@query(
    "expanding_daily_features",
    ctes("bars_15m_all", **_FEATURE_CTES, dd=_ED_DAYS, w=_FEATURE_DAYS) + f"SELECT series, day, horizon, {_FEATURE_ERRORS} FROM w GROUP BY 1, 2, 3",
)
def q_expanding_features(spark, sf):
    rows = V.expanding_daily_features(I.bars_15m_all(spark, sf), I.Q, _CHANGES, 20)
    e = E.error_metrics()
    return rounded(
        rows.groupBy("series", "day", "horizon").agg(
            e["mae"].alias("mae"), e["rmse"].alias("rmse"), F.count(F.lit(1)).alias("n")
        )
    )
