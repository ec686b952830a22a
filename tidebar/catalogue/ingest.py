"""Queries of the sources and stores."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from tidebar.catalogue import query
from tidebar.catalogue.common import CTES, HASH, KEY, ctes, over, rnd, rounded
from tidebar.functions.scalars import key_hash, series_key
from tidebar.operators.evaluate import metrics_by
from tidebar.operators.features import horizon_table, multi_horizon_targets
from tidebar.plans import inputs as I
from tidebar.plans import zones
from tidebar.session import new_path, stage
from tidebar.sources import bars as B
from tidebar.sources import macro_news as N
from tidebar.sources import store as K

OHLCV = "series, ts, open, high, low, close, volume"
CONFIG = os.path.join(os.path.dirname(__file__), "config.json")


@query("build_bars", ctes("bars_h") + f"SELECT {OHLCV} FROM bars_h")
def q_build_bars(spark, sf):
    return B.build_bars(I.ticks(spark, sf), "1 hour", ids=("event_id",))


@query("build_bars_daily", ctes("bars_d") + f"SELECT {OHLCV} FROM bars_d")
def q_build_bars_daily(spark, sf):
    return B.build_bars(I.order_ticks(spark, sf), "1 day", ids=("o_orderkey",))


@query("build_bars_composite_order", ctes("bars_d_flag") + f"SELECT {OHLCV} FROM bars_d_flag")
def q_build_bars_flag(spark, sf):
    return B.build_bars(I.line_ticks(spark, sf), "1 day", ids=I.LINE_IDS, volume=F.sum("l_quantity"))


@query(
    "sliding_bars",
    """WITH t AS (SELECT event_type AS series, ts, value, event_id,
          time_bucket(INTERVAL '15 minutes', ts) - to_minutes(15 * k::INTEGER) AS bar
          FROM events, range(4) r(k))
       SELECT series, bar AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
          last(value ORDER BY ts, event_id) AS close, count(*) AS volume FROM t GROUP BY series, bar""",
)
def q_sliding_bars(spark, sf):
    return B.build_bars(I.ticks(spark, sf), "1 hour", ids=("event_id",), slide="15 minutes")


_TF = {
    "m": "SELECT max(ts) AS last FROM bars_5m_all",
    "x": """SELECT '5m' AS timeframe, time_bucket(INTERVAL '5 minutes', ts) AS bar, INTERVAL '1 month' AS back, * FROM bars_5m_all
        UNION ALL SELECT '15m', time_bucket(INTERVAL '15 minutes', ts), INTERVAL '1 month', * FROM bars_5m_all
        UNION ALL SELECT '1h', time_bucket(INTERVAL '1 hour', ts), INTERVAL '6 months', * FROM bars_5m_all
        UNION ALL SELECT '1d', time_bucket(INTERVAL '1 day', ts), INTERVAL '1 year', * FROM bars_5m_all""",
    "tf": """SELECT timeframe, series, bar AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low,
        last(close ORDER BY ts) AS close, sum(volume)::BIGINT AS volume
        FROM x, m WHERE bar >= last - back GROUP BY timeframe, series, bar""",
}


@query("multi_timeframe_bars", ctes("bars_5m_all", **_TF) + f"SELECT timeframe, {OHLCV} FROM tf")
def q_multi_timeframe(spark, sf):
    return B.multi_timeframe_bars(I.bars_5m_all(spark, sf))


def _bars_table(spark, sf):
    """Bars of all timeframes as a table partitioned by timeframe."""
    path = new_path(spark, "timeframes")
    B.multi_timeframe_bars(I.bars_5m_all(spark, sf)).write.partitionBy("timeframe").parquet(path)
    return spark.read.parquet(path)


@query("select_timeframe", ctes("bars_5m_all", **_TF) + f"SELECT {OHLCV} FROM tf WHERE timeframe = '1h'")
def q_select_timeframe(spark, sf):
    return B.select_timeframe(_bars_table(spark, sf), "1hr").select(*OHLCV.split(", "))


@query(
    "lookback_slice",
    ctes("bars_d", m="SELECT series, max(ts) AS last FROM bars_d GROUP BY 1")
    + f"SELECT {OHLCV.replace('series', 'b.series')} FROM bars_d b JOIN m ON m.series = b.series WHERE ts >= last - INTERVAL '365 days'",
)
def q_lookback(spark, sf):
    return B.lookback_slice(I.bars_d(spark, sf), "365 days")


_GAP = f"CASE WHEN {HASH.format(KEY)} % 100 >= 40 THEN close END"


@query(
    "load_index_series",
    ctes("bars_d_all", g=f"SELECT *, {_GAP} AS c FROM bars_d_all")
    + f"SELECT series, ts, open, high, low, coalesce(last_value(c IGNORE NULLS) OVER {over()}, 0) AS close, volume::DOUBLE AS volume FROM g",
)
def q_index_series(spark, sf):
    rows = I.gappy(I.bars_d_all(spark, sf)).withColumn("volume", F.col("volume").cast("double"))
    return B.load_index_series(rows, I.D)


_PRICE = """SELECT last(strike ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS price
    FROM (SELECT *, l_extendedprice / l_quantity AS strike FROM lineitem)"""


@query(
    "atm_iv_summary",
    ctes(
        "quotes",
        p=_PRICE,
        a="""SELECT underlying, expiry,
            avg(CASE WHEN kind = 'call' AND abs(strike - price) / price < 0.1 THEN iv END) AS c,
            avg(CASE WHEN kind = 'put' AND abs(strike - price) / price < 0.1 THEN iv END) AS p FROM quotes, p GROUP BY 1, 2""",
        b="SELECT *, (c + p) / 2 AS m FROM a",
        f="""SELECT underlying, expiry, coalesce(last_value(c IGNORE NULLS) OVER w, 0) AS avg_iv_calls,
            coalesce(last_value(p IGNORE NULLS) OVER w, 0) AS avg_iv_puts, coalesce(last_value(m IGNORE NULLS) OVER w, 0) AS avg_iv
            FROM b WINDOW w AS (PARTITION BY underlying ORDER BY expiry)""",
    )
    + f"SELECT underlying, expiry, {rnd('avg_iv_calls', 'avg_iv_puts', 'avg_iv')} FROM f",
)
def q_atm_iv(spark, sf):
    price = B.latest_price(I.line_ticks(spark, sf), "price", I.LINE_IDS, ()).select("price").scalar()
    return rounded(B.atm_iv_summary(I.quotes(spark, sf), price))


@query("latest_price", ctes("bars_d") + "SELECT series, last(close ORDER BY ts) AS close, max(ts) AS ts FROM bars_d GROUP BY series")
def q_latest_price(spark, sf):
    return B.latest_price(I.bars_d(spark, sf))


@query(
    "load_macro",
    ctes("macro", g=f"SELECT name, ts, CASE WHEN {HASH.format('ts')} % 3 > 0 THEN value END AS v FROM macro")
    + "SELECT name, ts, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY name ORDER BY ts), 0) AS value FROM g",
)
def q_load_macro(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    rows = I.macro(spark, sf).withColumn("value", F.when(key_hash(stamp) % 3 > 0, F.col("value")))
    return N.load_macro(rows)


_FLAT = ctes(
    "articles",
    f="""SELECT doc_id, source AS source_id, upper(source) AS source_name, title,
        CASE WHEN doc_id % 11 = 0 THEN 'unknown' ELSE strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') END AS published
        FROM articles WHERE doc_id % 7 <> 0""",
)


@query(
    "flatten_articles",
    _FLAT + 'SELECT doc_id, source_id, source_name, title, published AS "publishedAt" FROM f',
)
def q_flatten(spark, sf):
    rows = N.flatten_articles(I.payloads(spark, sf))
    return rows.select("doc_id", "source_id", "source_name", "title", "publishedAt")


@query(
    "json_properties",
    "SELECT event_type AS series, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2",
)
def q_json_props(spark, sf):
    rows = I.table(spark, sf, "events").select(
        F.col("event_type").alias("series"), F.from_json("props", "k bigint").getField("k").alias("k")
    )
    return rows.groupBy("series", "k").agg(F.count(F.lit(1)).alias("n"))


@query(
    "article_timestamps",
    _FLAT
    + """, t AS (SELECT doc_id, source_id, try_strptime(published, '%Y-%m-%dT%H:%M:%SZ') AS d FROM f)
    SELECT doc_id, source_id, coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY doc_id),
        first_value(d IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY doc_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS datetime FROM t""",
)
def q_article_timestamps(spark, sf):
    rows = N.flatten_articles(I.payloads(spark, sf))
    # the order of arrival: one article an hour
    rows = rows.withColumn(
        "ts", F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(hours=F.col("doc_id").cast("int"))
    )
    order = zones.Order(3600, ("source_id",))
    load_date = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return N.article_timestamps(rows, order, load_date).select("doc_id", "source_id", "datetime")


_PHRASES = ["the of", "on the", "ing"]


def _hits(p):
    return f"((length(lower(text)) - length(replace(lower(text), '{p}', ''))) / {len(p)})::INTEGER"


@query(
    "news_window_filter",
    ctes(
        "articles",
        u="SELECT max(published_at) AS until FROM articles",
        r=f"SELECT *, {' + '.join(_hits(p) for p in _PHRASES)} AS relevance FROM articles",
    )
    + """SELECT doc_id, title, published_at, relevance FROM r, u
       WHERE lang = 'en' AND published_at BETWEEN until - INTERVAL '30 days' AND until AND relevance > 0""",
)
def q_news_window(spark, sf):
    rows = I.articles(spark, sf)
    until = rows.agg(F.max("published_at")).scalar()
    return N.news_window_filter(rows, _PHRASES, until).select("doc_id", "title", "published_at", "relevance")


_SENTIMENT = ctes(
    "articles",
    w=r"""SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS token FROM articles""",
    lex=f"SELECT token, ({HASH.format('token')} % 201 - 100) / 100 AS polarity FROM (SELECT DISTINCT token FROM w WHERE token <> '')",
    s="""SELECT a.doc_id, coalesce(avg(l.polarity::DECIMAL(18, 9)), 0) AS polarity FROM articles a LEFT JOIN w ON w.doc_id = a.doc_id
        LEFT JOIN lex l ON l.token = w.token GROUP BY a.doc_id""",
)


@query("title_sentiment", _SENTIMENT + f"SELECT doc_id, {rnd('polarity')} FROM s")
def q_title_sentiment(spark, sf):
    scored = N.title_sentiment(I.articles(spark, sf), I.lexicon(spark, sf), "doc_id", "text")
    return rounded(scored.select("doc_id", "polarity"))


@query("mean_sentiment", _SENTIMENT + "SELECT round(coalesce(avg(polarity), 0), 4) AS avg_sentiment, count(*) AS articles FROM s")
def q_mean_sentiment(spark, sf):
    return rounded(N.mean_sentiment(N.title_sentiment(I.articles(spark, sf), I.lexicon(spark, sf), "doc_id", "text")), 4)


@query(
    "horizon_table",
    ctes(
        "bars_h",
        h="SELECT * FROM (VALUES ('24h', 26), ('48h', 52), ('72h', 78), ('96h', 104), ('168h', 182)) t(label, steps)",
        n=f"SELECT series, count(*) AS n FROM bars_h GROUP BY 1",
    )
    + "SELECT series, label, steps, greatest(n - steps, 0)::BIGINT AS targets FROM n, h",
)
def q_horizon_table(spark, sf):
    path = new_path(spark, "config")
    with open(CONFIG) as f:
        text = json.dumps(json.load(f))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    horizons = horizon_table(spark, path, "intervals_market_hours")
    bars = I.bars_h(spark, sf).groupBy("series").agg(F.count(F.lit(1)).alias("n"))
    # the configuration has a handful of rows: each series is expanded to all of them
    pairs = horizons.agg(F.collect_list(F.struct("label", "steps")).alias("h")).scalar()
    rows = bars.select("series", "n", F.inline(pairs))
    return rows.select(
        "series", "label", "steps", F.greatest(F.col("n") - F.col("steps"), F.lit(0)).cast("long").alias("targets")
    )


# -- stores ------------------------------------------------------------------

_DAY = "SELECT 'bars' AS dataset, timeframe, series, ts, close FROM tf"


@query(
    "overwrite_datasets",
    ctes("bars_5m_all", **_TF)
    + """SELECT 'bars' AS dataset, timeframe, series, ts, CASE WHEN timeframe = '1h' THEN close * 2 ELSE close END AS close FROM tf""",
)
def q_overwrite(spark, sf):
    path = new_path(spark, "datasets")
    rows = _bars_table(spark, sf).select(F.lit("bars").alias("dataset"), "timeframe", "series", "ts", "close")
    K.overwrite_datasets(rows, path)
    K.overwrite_datasets(rows.where(F.col("timeframe") == "1h").withColumn("close", F.col("close") * 2), path)
    return spark.read.parquet(path).select("dataset", "timeframe", "series", "ts", "close")


@query("load_or_empty", ctes("macro") + "SELECT name, ts, value FROM macro")
def q_load_or_empty(spark, sf):
    rows = I.macro(spark, sf)
    path = new_path(spark, "store")
    missing = K.load_or_empty(spark, path + "-absent", rows.schema)
    rows.write.parquet(path)
    return K.load_or_empty(spark, path, rows.schema).unionByName(missing)


@query(
    "append_dedup",
    """SELECT DISTINCT event_type AS series, ts, value, event_id FROM events""",
)
def q_append_dedup(spark, sf):
    rows = I.table(spark, sf, "events").select(F.col("event_type").alias("series"), "ts", "value", "event_id")
    old, new = rows.where(F.col("event_id") % 3 != 0), rows.where(F.col("event_id") % 3 != 1)
    return K.append_dedup(old, new)


@query(
    "append_sentiment",
    _SENTIMENT
    + """SELECT TIMESTAMP '2024-10-18 12:00:00' + to_days(k::INTEGER) AS timestamp, round(a, 4) AS score
       FROM (SELECT coalesce(avg(polarity), 0) AS a FROM s), range(2) r(k)""",
)
def q_append_sentiment(spark, sf):
    path = new_path(spark, "sentiment")
    score = N.mean_sentiment(N.title_sentiment(I.articles(spark, sf), I.lexicon(spark, sf), "doc_id", "text"))
    score = stage(score, "score")  # one row: computed once, appended per day
    for day in ("2024-10-18 12:00:00", "2024-10-19 12:00:00"):
        K.append_sentiment(score, path, F.lit(day))
    return rounded(spark.read.parquet(path), 4)


HORIZONS = (12, 24, 36, 48, 72, 96)


def _naive(spark, sf, horizons=HORIZONS):
    """Last close and yesterday's close as two forecasts, long."""
    bars = zones.over(I.bars_h(spark, sf).select("series", "ts", "close"), I.H, before=1, lag1=lambda w: F.lag("close").over(w))
    rows = multi_horizon_targets(bars, I.H, horizons).where(F.col("lag1").isNotNull())
    return rows.withColumnRenamed("target", "actual").unpivot(
        ["series", "ts", "horizon", "actual"], ["close", "lag1"], "model", "predicted"
    )


_NAIVE = {
    "l": f"""SELECT series, ts, close, lag(close) OVER {over()} AS lag1,
        {', '.join(f"lead(close, {h}) OVER {over()} AS a{h}" for h in HORIZONS)} FROM bars_h""",
    "n": " UNION ALL ".join(
        f"SELECT series, '{h}' AS horizon, a{h} AS actual, '{m}' AS model, {m} AS predicted FROM l WHERE lag1 IS NOT NULL AND a{h} IS NOT NULL"
        for h in HORIZONS
        for m in ("close", "lag1")
    ),
    "e": """SELECT model, horizon, avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse
        FROM n GROUP BY 1, 2""",
}


@query("write_metrics", ctes("bars_h", **_NAIVE) + f"SELECT model, horizon, {rnd('mae', 'rmse')} FROM e")
def q_write_metrics(spark, sf):
    path = new_path(spark, "metrics")
    metrics = metrics_by(_naive(spark, sf)).select("model", "horizon", "mae", "rmse")
    K.write_metrics(metrics, path)
    return rounded(spark.read.schema(metrics.schema).json(path))


@query(
    "best_params_gate",
    ctes(
        "bars_h",
        **_NAIVE,
        c="SELECT * FROM e WHERE model = 'lag1'",
        b="SELECT horizon, mae * (CASE WHEN horizon = '12' THEN 0.85 ELSE 1.0 END) AS bm, rmse AS br FROM e WHERE model = 'close'",
    )
    + f"""SELECT horizon, CASE WHEN mae > bm * 1.1 OR rmse > br * 1.1 THEN 'keep' ELSE 'replace' END AS decision,
        {rnd('CASE WHEN mae > bm * 1.1 OR rmse > br * 1.1 THEN bm ELSE mae END AS mae',
             'CASE WHEN mae > bm * 1.1 OR rmse > br * 1.1 THEN br ELSE rmse END AS rmse')}
        FROM c JOIN b USING (horizon)""",
)
def q_best_params_gate(spark, sf):
    m = metrics_by(_naive(spark, sf))
    current = m.where(F.col("model") == "lag1").select("horizon", "mae", "rmse")
    factor = F.when(F.col("horizon") == "12", 0.85).otherwise(1.0)
    best = m.where(F.col("model") == "close").select("horizon", (F.col("mae") * factor).alias("mae"), "rmse")
    return rounded(K.best_params_gate(current, best, ("horizon",)))


@query(
    "save_weights",
    ctes("bars_h", **_NAIVE, t="SELECT horizon, sum(mae) AS total FROM e GROUP BY 1")
    + "SELECT horizon, model, round(1 - mae / total, 6) AS w FROM e JOIN t USING (horizon)",
)
def q_save_weights(spark, sf):
    path = new_path(spark, "weights")
    m = metrics_by(_naive(spark, sf))
    total = m.groupBy("horizon").agg(F.sum("mae").alias("total"))
    weights = m.join(total, "horizon").select("horizon", "model", (1 - F.col("mae") / F.col("total")).alias("w"))
    K.save_weights(weights.withColumn("w", F.lit(0.5)), path)
    K.save_weights(weights, path)
    return rounded(spark.read.parquet(path).select(F.col("horizon").cast("string").alias("horizon"), "model", "w"))


_DEFAULTS = ", ".join(f"('{m}', '{n}', {float(v)})" for m, p in K.DEFAULT_PARAMS.items() for n, v in p.items())


@query(
    "params_table",
    f"""WITH d(model, name, dv) AS (VALUES {_DEFAULTS}),
       s AS (SELECT 'random_forest' AS model, 'trees' AS name, (count(*) / 50)::INTEGER::DOUBLE AS value FROM orders
             UNION ALL SELECT 'ridge', 'alpha', round(avg(o_totalprice), 2) FROM orders)
       SELECT coalesce(d.model, s.model) AS model, coalesce(d.name, s.name) AS name, coalesce(value, dv)::DOUBLE AS value
       FROM d FULL JOIN s ON s.model = d.model AND s.name = d.name""",
)
def q_params_table(spark, sf):
    orders = I.table(spark, sf, "orders")
    trees = orders.agg(F.round(F.count(F.lit(1)) / 50).alias("value"))
    alpha = orders.agg(F.round(F.avg("o_totalprice"), 2).alias("value"))
    saved = trees.select(F.lit("random_forest").alias("model"), F.lit("trees").alias("name"), "value").unionByName(
        alpha.select(F.lit("ridge").alias("model"), F.lit("alpha").alias("name"), "value")
    )
    return K.params_table(spark, saved)


@query(
    "dataset_summary",
    ctes(
        "bars_5m_all", "macro", **_TF
    )
    + """SELECT 'bars ' || timeframe AS dataset, count(*) AS n_rows, 8 AS n_columns, false AS is_empty FROM tf GROUP BY timeframe
       UNION ALL SELECT 'macro', count(*), 3, count(*) = 0 FROM macro
       UNION ALL SELECT 'none', 0, 3, true""",
)
def q_dataset_summary(spark, sf):
    bars = _bars_table(spark, sf)
    macro = I.macro(spark, sf)
    frames = {f"bars {t}": bars.where(F.col("timeframe") == t) for t in B.TIMEFRAMES}
    return K.dataset_shapes({**frames, "macro": macro, "none": macro.where(F.lit(False))})
