"""Hand-checked values on tiny inputs."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidebar.operators import clean as C
from tidebar.operators import evaluate as E
from tidebar.operators import features as X
from tidebar.operators import indicators as ind
from tidebar.operators import resample as R
from tidebar.operators import trades as T
from tidebar.operators.ewm import ewm
from tidebar.plans import zones
from tidebar.sources import bars as B
from tidebar.sources import macro_news as N
from tidebar.sources import store as K

START = dt.datetime(2024, 1, 1)
H = zones.HOURLY


def bars(spark, closes, high=1.0, low=1.0, volume=10.0):
    rows = [
        ("a", START + dt.timedelta(hours=i), c, c + high, c - low, c, volume) for i, c in enumerate(closes)
    ]
    schema = "series string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
    return spark.createDataFrame(rows, schema)


def column(df, name):
    return [r[name] for r in df.orderBy("ts").select(name).collect()]


def errors(spark, actual, predicted):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(actual, predicted)], "actual double, predicted double")
    return df.agg(*[a.alias(n) for n, a in {**E.error_metrics(), **E.spread_interval()}.items()]).first()


def test_error_metrics_and_interval(spark):
    row = errors(spark, [100, 102, 98, 101, 99, 103, 105], [101, 101, 97, 100, 100, 102, 106])
    assert row["mae"] == 1 and row["rmse"] == 1 and row["avg_diff"] == 1
    assert row["ci_low"] == pytest.approx(99.11965, abs=1e-5)
    assert row["ci_high"] == pytest.approx(102.88035, abs=1e-5)


def test_error_metrics_plotted_pairs(spark):
    row = errors(spark, [580.76, 573.61, 584.84, 581.23, 582.38], [580.76, 574.39, 584.63, 580.17, 581.98])
    assert row["mae"] == pytest.approx(0.49) and row["rmse"] == pytest.approx(0.62227, abs=1e-5)


def test_rsi_rising_and_flat(spark):
    def rsi(closes):
        z = ind.with_rsi(zones.enter(bars(spark, closes), H, before=20), zones.window(H))
        return column(zones.leave(z), "rsi")

    assert rsi([float(i) for i in range(14)])[12:] == [0.0, 100.0]
    assert rsi([5.0] * 14)[13] == 0.0


def test_first_true_range_is_high_minus_low(spark):
    z = ind.with_true_range(zones.enter(bars(spark, [10.0, 20.0]), H, before=1), zones.window(H))
    assert column(zones.leave(z), "tr") == [2.0, 11.0]


def test_warm_up_rows(spark):
    closes = [100 + 10 * math.sin(i) + i * 0.1 for i in range(60)]
    df = bars(spark, closes)
    z = zones.enter(df, H, before=40)
    w = zones.window(H)
    z = ind.with_directional_movement(ind.with_true_range(z, w), w)
    z = ind.with_adx(ind.with_directional_index(z, w), w)
    out = zones.leave(z)
    first = lambda values, missing: next(i for i, v in enumerate(values) if v != missing) + 1
    assert first(column(out, "plus_di"), None) == 15
    assert first(column(out, "adx"), 0.0) == 28
    rsi = zones.leave(ind.with_rsi(zones.enter(df, H, before=20), w))
    assert first(column(rsi, "rsi"), 0.0) == 14


def test_market_day_has_27_slots(spark):
    bounds = spark.createDataFrame(
        [("a", dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 2, 23, 45))], "series string, first timestamp_ntz, last timestamp_ntz"
    )
    assert R.calendar_grid(bounds, weekdays_only=True, market_hours=True).count() == 27


def test_calendar_grid_from_an_odd_start(spark):
    first, last = dt.datetime(2024, 1, 5, 22, 30), dt.datetime(2024, 1, 8, 1, 0)
    bounds = spark.createDataFrame([("a", first, last)], "series string, first timestamp_ntz, last timestamp_ntz")
    every = [first + dt.timedelta(minutes=15 * k) for k in range(1000) if first + dt.timedelta(minutes=15 * k) <= last]
    assert column(R.calendar_grid(bounds), "ts") == every
    assert column(R.calendar_grid(bounds, weekdays_only=True), "ts") == [t for t in every if t.weekday() < 5]


def test_interpolation_by_position(spark):
    rows = [("a", START + dt.timedelta(hours=i), v) for i, v in enumerate([None, 1.0, None, 3.0, None])]
    df = spark.createDataFrame(rows, "series string, ts timestamp_ntz, close double")
    assert column(R.interpolate_linear(df, H, ["close"]), "close") == [None, 1.0, 2.0, 3.0, 3.0]


def test_sequence_counts(spark):
    df = bars(spark, [float(i) for i in range(100)])
    seq = X.sequences(df, H, ("close", "high"), 48, 26)
    assert seq.count() == 100 - 48 - 26 + 1
    alternating = X.sequences_alternating(X.minmax_scale(df, ["close"]), H)
    assert column(alternating.orderBy("start"), "seq_len")[:5] == [13, 13, 14, 13, 14]
    assert alternating.count() == 100 - 10 - 14
    assert {len(s) for s in column(alternating, "sequence")} == {14}


def test_short_series_is_an_error_for_next_row_sequences(spark):
    with pytest.raises(Exception, match="fewer than 48 rows"):
        X.sequences_next(bars(spark, [1.0] * 20), H, ("close",)).collect()


def test_atm_range_is_strict(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [("u", day, "call", s, iv) for s, iv in ((90.0, 1.0), (90.01, 2.0), (110.0, 4.0))]
    rows += [("u", day, "put", 100.0, 6.0), ("u", dt.datetime(2024, 2, 1), "put", 500.0, 9.0)]
    quotes = spark.createDataFrame(rows, "underlying string, expiry timestamp_ntz, kind string, strike double, iv double")
    out = B.atm_iv_summary(quotes, F.lit(100.0)).orderBy("expiry").collect()
    assert [(r["avg_iv_calls"], r["avg_iv_puts"], r["avg_iv"]) for r in out] == [(2.0, 6.0, 4.0)] * 2


def trade(spark, kind, close, strike=100.0, confidence=0.0):
    df = spark.createDataFrame(
        [(kind, close, strike, 2.0, 1.0, 10.0, 0.5, 8.0, 5.0, confidence)],
        "trade_type string, close_price double, strike double, premium_received double, premium_paid double,"
        "volatility double, time_decay double, max_profit double, max_loss double, confidence double",
    )
    return T.simulate_trades(df).first()["profit_loss"]


def test_option_payoffs_at_their_bounds(spark):
    assert trade(spark, "credit_spread", 100.0) == 1 and trade(spark, "credit_spread", 100.01) == -5
    assert trade(spark, "debit_spread", 100.0) == -1 and trade(spark, "debit_spread", 99.99) == 7
    assert [trade(spark, "iron_condor", c) for c in (100.0, 101.0, 102.0)] == [-5, 1, -5]
    assert trade(spark, "straddle", 105.0) == -1 and trade(spark, "straddle", 105.01) == 1
    assert trade(spark, "other", 100.0) == 0


def test_roll_and_risk(spark):
    assert trade(spark, "credit_spread", 101.0, confidence=0.6) == pytest.approx(-4.2)
    assert trade(spark, "credit_spread", 101.0, confidence=0.5) == -5
    df = spark.createDataFrame([(-2.0, None), (3.0, None), (1.0, None), (1.0, False)], "profit_loss double, successful boolean")
    out = df.select(*[c.alias(n) for n, c in T.risk_management(-2, 3).items()]).collect()
    assert [tuple(r) for r in out] == [(-2.0, False), (3.0, True), (1.0, True), (1.0, False)]
    both = df.limit(1).select(*[c.alias(n) for n, c in T.risk_management(0, -5).items()]).first()
    assert tuple(both) == (0.0, False)


def test_constant_mean_is_the_constant(spark):
    out = column(ewm(bars(spark, [7.5] * 300), H.with_rows(32), {"m": ("close", 21)}), "m")
    assert max(abs(v - 7.5) for v in out) < 1e-12


def test_unknown_requests_are_errors(spark):
    df = bars(spark, [1.0]).withColumn("timeframe", F.lit("1h"))
    with pytest.raises(ValueError):
        B.select_timeframe(df, "2h")
    with pytest.raises(ValueError):
        C.ensure_datetime(df, ["absent"], H, F.lit("2024-01-01").cast("timestamp_ntz"))
    with pytest.raises(ValueError):
        C.fill_chain(df, H, ["close"], ("sideways",))


def test_unreadable_dates_fall_back_to_now(spark):
    df = spark.createDataFrame([("a", START, "x"), ("a", START + dt.timedelta(hours=1), "y")], "series string, ts timestamp_ntz, d string")
    out = C.ensure_datetime(df, ["d"], H, F.lit("2030-01-01").cast("timestamp_ntz"))
    assert column(out, "datetime") == [dt.datetime(2030, 1, 1)] * 2


def test_no_articles_mean_zero(spark):
    empty = spark.createDataFrame([], "doc_id long, title string")
    lexicon = spark.createDataFrame([("up", 0.5)], "token string, polarity double")
    assert N.mean_sentiment(N.title_sentiment(empty, lexicon, "doc_id")).first()["avg_sentiment"] == 0.0
    one = spark.createDataFrame([(1, "Up, up and down"), (2, "nothing")], "doc_id long, title string")
    scored = {r["doc_id"]: r["polarity"] for r in N.title_sentiment(one, lexicon, "doc_id").collect()}
    assert scored == {1: 0.5, 2: 0.0}


def test_articles_without_dates_take_the_load_date(spark):
    df = spark.createDataFrame([("s", START)], "source_id string, ts timestamp_ntz")
    out = N.article_timestamps(df, zones.Order(3600, ("source_id",)), F.lit("2024-05-05"))
    assert column(out, "datetime") == [dt.datetime(2024, 5, 5)]


def test_gate_without_saved_metrics_takes_the_new_ones(spark):
    new = spark.createDataFrame([("24h", 1.0, 2.0), ("48h", 1.2, 1.0)], "horizon string, mae double, rmse double")
    old = spark.createDataFrame([("48h", 1.0, 1.0)], "horizon string, mae double, rmse double")
    out = {r["horizon"]: (r["decision"], r["mae"]) for r in K.best_params_gate(new, old, ("horizon",)).collect()}
    assert out == {"24h": ("replace", 1.0), "48h": ("keep", 1.0)}
