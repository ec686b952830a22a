"""Properties of the zone layout: its size, the row order and uneven data never change a result."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebar.operators import clean as C
from tidebar.operators import enrich, indicators, signals
from tidebar.operators import features as X
from tidebar.operators import splits as V
from tidebar.operators.ewm import ewm
from tidebar.plans import zones

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def uneven(spark):
    """One long series, a short one, a gap of a year, a burst far denser than the step, missing closes."""
    rng = random.Random(7)
    rows, t = [], START
    for i in range(900):
        t += dt.timedelta(hours=1)
        if i == 300:
            t += dt.timedelta(days=365)
        rows.append(("long", t, rng.uniform(1, 100) if rng.random() > 0.5 else None, rng.uniform(1, 100)))
    for i in range(500):
        rows.append(("burst", START + dt.timedelta(seconds=i), rng.uniform(1, 9) if i in (0, 450) else None, rng.uniform(1, 9)))
    rows.append(("one", START, None, 5.0))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "series string, ts timestamp_ntz, gappy double, close double")
    return df.cache()


def frame(df):
    return df.toPandas().sort_values(["series", "ts"]).reset_index(drop=True)


@pytest.mark.parametrize("rows", [16, 50, 4096])
def test_windows_fills_and_means_equal_pandas(uneven, rows):
    order = zones.Order(3600, rows=rows)
    z = zones.enter(uneven, order, before=13, after=5)
    w = zones.window(order)
    z = z.withColumns(
        {"mean14": indicators.full(F.avg, "close", w, 14), "lead5": F.lead("close", 5).over(w), "row": F.col("_pos"), "n": F.col("_n")}
    )
    got = frame(zones.leave(z))
    g = frame(uneven).groupby("series")
    want = frame(uneven)
    assert len(got) == len(want)
    np.testing.assert_allclose(got["mean14"], g["close"].transform(lambda x: x.rolling(14).mean()))
    np.testing.assert_allclose(got["lead5"], g["close"].shift(-5))
    assert (got["row"] == g.cumcount()).all() and (got["n"] == g["close"].transform("size")).all()

    filled = frame(C.fill_chain(uneven, order, ["gappy"], ("ffill",)))
    np.testing.assert_allclose(filled["gappy"], g["gappy"].ffill())
    filled = frame(C.fill_chain(uneven, order, ["gappy"], ("bfill", "zero")))
    np.testing.assert_allclose(filled["gappy"], g["gappy"].bfill().fillna(0))

    out = frame(ewm(uneven, order, {"m2": ("close", 2), "m9": ("close", 9), "m200": ("close", 200), "m1": ("close", 1)}))
    for span in (1, 2, 9, 200):
        expect = g["close"].transform(lambda x: x.ewm(span=span, adjust=False).mean())
        np.testing.assert_allclose(out[f"m{span}"], expect, rtol=1e-12)

    z = zones.running_sum(zones.enter(uneven, order), order, {"total": F.col("close")})
    np.testing.assert_allclose(frame(zones.leave(z))["total"], g["close"].cumsum())


def test_old_extreme_value_decays_exactly(spark):
    """A first value of 1e280 outweighs later ones for thousands of rows; nothing may cut it off."""
    x = [1e280] + [1.0] * 4000
    df = spark.createDataFrame([("a", START + dt.timedelta(hours=i), v) for i, v in enumerate(x)], "series string, ts timestamp_ntz, close double")
    out = frame(ewm(df, zones.Order(3600, rows=64), {"m": ("close", 9)}))["m"]
    np.testing.assert_allclose(out, pd.Series(x).ewm(span=9, adjust=False).mean(), rtol=1e-9)


def test_nested_mean_equals_mean_of_mean(uneven):
    order = zones.Order(3600, rows=64)
    z = indicators.with_macd(zones.enter(uneven, order), order, 8, 21, 9)
    same = indicators.with_macd(zones.enter(uneven, order), order, 9, 21, 9)
    for got, fast in ((frame(zones.leave(z)), 8), (frame(zones.leave(same)), 9)):
        g = frame(uneven).groupby("series")["close"]
        macd = g.transform(lambda x: x.ewm(span=fast, adjust=False).mean() - x.ewm(span=21, adjust=False).mean())
        signal = macd.groupby(frame(uneven)["series"]).transform(lambda x: x.ewm(span=9, adjust=False).mean())
        np.testing.assert_allclose(got["macd_signal"], signal, atol=1e-11)


def test_fill_twice_is_fill_once(uneven):
    order = zones.Order(3600, rows=64)
    once = C.ffill(uneven, order, ["gappy"])
    pd.testing.assert_frame_equal(frame(once), frame(C.ffill(once, order, ["gappy"])))


def test_row_order_and_partitions_do_not_matter(spark, uneven):
    order = zones.Order(3600, rows=64)
    a = frame(ewm(uneven, order, {"m": ("close", 9)}))
    b = frame(ewm(uneven.repartition(7, "close"), order, {"m": ("close", 9)}))
    pd.testing.assert_frame_equal(a, b)


def test_fitted_order_measures_density(uneven):
    order = zones.fit(uneven, zones.Order(3600))
    assert order.step == pytest.approx(1.0, rel=0.01) and order.rows is None
    assert zones.fit(uneven, zones.Order(3600, rows=64), most_zones=2).rows == 64
    assert zones.fit(uneven.crossJoin(uneven.limit(20).select("ts").withColumnRenamed("ts", "_")), zones.Order(3600), most_zones=2).rows == 9000
    assert zones.fit(uneven.limit(0), zones.Order(3600)) == zones.Order(3600)


def test_zone_tasks_are_bounded(uneven):
    """No zone holds more than its rows, one bucket and the context, except where one bucket is larger."""
    order = zones.Order(1, rows=64)
    z = zones.enter(uneven.where(F.col("series") != "long"), order, before=10)
    assert z.groupBy("series", "_zone").count().agg(F.max("count")).first()[0] <= 64 + 4 + 10 + 4


def test_inverse_of_scaling(uneven):
    fitted = X.scaler(uneven, ["close"])
    scaled = X.minmax_scale(uneven, ["close"], fitted)
    back = frame(X.inverse_scale(scaled, "close_scaled", "close", fitted, "again"))
    np.testing.assert_allclose(back["again"], back["close"])
    one = X.minmax_scale(uneven, ["close"]).where(F.col("series") == "one").first()
    assert one["close_scaled"] == 0.0


def bars(spark, n):
    rng = random.Random(3)
    price, rows = 100.0, []
    for i in range(n):
        price += rng.uniform(-1, 1)
        rows.append(("a", START + dt.timedelta(hours=i), price, price + rng.random(), price - rng.random(), price, float(i % 7)))
    schema = "series string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
    return spark.createDataFrame(rows, schema)


def test_no_indicator_looks_ahead(spark):
    order = zones.Order(3600, rows=64)
    long = frame(signals.signals_from_bars(bars(spark, 300), order, keep=("rsi", "adx", "mfi", "macd_signal", "atr")))
    short = frame(signals.signals_from_bars(bars(spark, 200), order, keep=("rsi", "adx", "mfi", "macd_signal", "atr")))
    pd.testing.assert_frame_equal(long.head(200), short, atol=1e-10)


def test_flat_prices_have_no_missing_indicator(spark):
    rows = [("a", START + dt.timedelta(hours=i), 5.0, 5.0, 5.0, 5.0, 1.0) for i in range(80)]
    schema = "series string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
    out = frame(indicators.indicator_frame(spark.createDataFrame(rows, schema), zones.Order(3600, rows=16)))
    assert not out.isna().any().any() and (out["adx"] == 0).all() and (out["plus_di"] == 0).all()


@pytest.mark.parametrize("rows", [16, 4096])
def test_asof_equals_pandas(spark, rows):
    rng = random.Random(5)
    left = pd.DataFrame({"series": [rng.choice("ab") for _ in range(300)], "ts": [START + dt.timedelta(minutes=rng.randrange(9000)) for _ in range(300)]})
    left["id"] = range(300)
    right = pd.DataFrame({"series": ["a"] * 40 + ["b"] * 40, "ts": [START + dt.timedelta(minutes=200 * (k % 40) + 60) for k in range(80)]})
    right["v"] = [None if k % 9 == 0 else float(k) for k in range(80)]
    right["found"] = 1
    ls = spark.createDataFrame(left, "series string, ts timestamp_ntz, id long")
    rs = spark.createDataFrame(
        [(r.series, r.ts.to_pydatetime(), None if pd.isna(r.v) else r.v, r.found) for r in right.itertuples()],
        "series string, ts timestamp_ntz, v double, found long",
    )
    got = enrich.asof_enrich(ls, rs, ["v", "found"], ("series",), zones.Order(60, rows=rows)).toPandas().set_index("id").sort_index()
    want = pd.merge_asof(left.sort_values("ts"), right.sort_values("ts"), on="ts", by="series").set_index("id").sort_index()
    np.testing.assert_allclose(got["v"].astype(float), want["v"].astype(float))
    np.testing.assert_allclose(got["found"].astype(float), want["found"].astype(float))
    whole = enrich.asof_calendar(ls, rs.where("series = 'a'"), ["v"]).toPandas().set_index("id").sort_index()
    want = pd.merge_asof(left.sort_values("ts"), right[right.series == "a"][["ts", "v"]], on="ts").set_index("id").sort_index()
    np.testing.assert_allclose(whole["v"].astype(float), want["v"].astype(float))


def test_rolling_by_series_window_is_the_same(uneven):
    order = zones.Order(3600, rows=32)
    zoned = frame(zones.over(uneven, order, before=4, m=lambda w: F.avg("close").over(w.rowsBetween(-4, 0))))
    plain = frame(uneven.withColumn("m", F.avg("close").over(Window.partitionBy("series").orderBy("ts").rowsBetween(-4, 0))))
    pd.testing.assert_frame_equal(zoned, plain)


@pytest.fixture(scope="module")
def bursts(spark):
    """A third of the rows in one second, hundreds at one instant told apart by an id, and rows without a time or a key."""
    rng = random.Random(9)
    rows = [("a", START + dt.timedelta(hours=i), i, rng.uniform(1, 9)) for i in range(600)]
    rows += [("a", START + dt.timedelta(hours=300, microseconds=rng.randrange(10**6)), 1000 + i, rng.uniform(1, 9)) for i in range(700)]
    rows += [("a", START + dt.timedelta(hours=301, seconds=1), 10**12 + rng.randrange(10**9), rng.uniform(1, 9)) for i in range(500)]
    rows += [("b", START, None if i == 3 else i * i * i, rng.uniform(1, 9)) for i in range(400)]
    lost = [("a", None, i, 1.0) for i in range(300)] + [(None, START, 1, 2.0)] * 200 + [(None, None, None, None)] * 100
    rows, lost = list(dict.fromkeys(rows)), lost
    every = rows + lost
    rng.shuffle(every)
    schema = "series string, ts timestamp_ntz, id long, close double"
    return spark.createDataFrame(every, schema).repartition(5).cache(), len(lost)


def in_order(df):
    return df.sort_values(["series", "ts", "id"], na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("small, long_map", [(True, None), (False, None), (False, "20")])
def test_bursts_are_split_and_rows_without_a_place_kept(spark, monkeypatch, bursts, small, long_map):
    given, n_lost = bursts
    monkeypatch.setattr(zones, "SMALL_INPUT", 1 << 40 if small else 0)
    if long_map:
        spark.conf.set(zones.LONG_MAP_CONF, long_map)
    try:
        order = zones.Order(3600, ties=("id",), rows=64)
        z = zones.enter(given, order, before=3, after=2)
        sizes = z.where("_core AND _pos IS NOT NULL").groupBy("series", "_zone").count().toPandas()["count"]
        assert sizes.max() <= 2 * 64
        alone = z.where("_pos IS NULL").groupBy("_zone").count().toPandas()["count"]
        assert len(alone) == n_lost and alone.max() == 1
        w = zones.window(order)
        z = z.withColumns({"before": F.lag("close", 3).over(w), "after": F.lead("close", 2).over(w), "row": F.col("_pos"), "whole": F.lit(1)})
        out = zones.leave(z).toPandas()
        total = zones.leave(zones.running_sum(zones.enter(given, order), order, {"total": F.col("close")})).toPandas()
        means = ewm(given, order, {"m": ("close", 9)}).toPandas()
    finally:
        spark.conf.unset(zones.LONG_MAP_CONF)
    have = given.toPandas()
    placed = have["ts"].notna() & have["series"].notna()
    want = in_order(have[placed])
    g = want.groupby("series")["close"]
    for got in (out, total, means):
        assert len(got) == len(have)
        left = got[got["ts"].isna() | got["series"].isna()]
        added = [c for c in got.columns if c not in have.columns]
        assert len(left) == n_lost and left[added].isna().all().all()
        pd.testing.assert_frame_equal(
            in_order(left[list(have.columns)]).fillna(-1).sort_values(["id", "close"]).reset_index(drop=True),
            in_order(have[~placed]).fillna(-1).sort_values(["id", "close"]).reset_index(drop=True), check_dtype=False,
        )
    out, total, means = (in_order(x[x["ts"].notna() & x["series"].notna()]) for x in (out, total, means))
    assert (out["row"] == want.groupby("series").cumcount()).all()
    np.testing.assert_allclose(out["before"], g.shift(3))
    np.testing.assert_allclose(out["after"], g.shift(-2))
    np.testing.assert_allclose(total["total"], g.cumsum())
    np.testing.assert_allclose(means["m"], g.transform(lambda x: x.ewm(span=9, adjust=False).mean()), rtol=1e-12)


def test_fills_keep_rows_without_a_place(spark):
    rows = [("a", START, 1.0), ("a", START + dt.timedelta(hours=1), None), ("a", None, None), (None, START, None), (None, None, 7.0)]
    df = spark.createDataFrame(rows, "series string, ts timestamp_ntz, close double")
    got = sorted(C.ffill(df, zones.HOURLY, ["close"]).collect(), key=str)
    want = sorted([("a", START, 1.0), ("a", START + dt.timedelta(hours=1), 1.0), ("a", None, None), (None, START, None), (None, None, 7.0)], key=str)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    split = V.chronological_split(df, zones.HOURLY).collect()
    assert len(split) == 5 and sum(r["split"] is None for r in split) == 3


def test_as_of_with_a_dense_right_side(spark):
    """A value every second for hours, left rows far apart and many at one instant; zones stay small."""
    right = [(START + dt.timedelta(seconds=i), float(i) if i % 7 else None) for i in range(9000)]
    left = [("a" if i % 2 else "b", START + dt.timedelta(seconds=i * 37 - 100, microseconds=500), i) for i in range(200)]
    left += [(f"s{i % 5}", START + dt.timedelta(seconds=4000), 1000 + i) for i in range(900)] + [("a", None, 5000), (None, START, 5001)]
    ls = spark.createDataFrame(left, "series string, ts timestamp_ntz, id int").repartition(4)
    rs = spark.createDataFrame(right, "ts timestamp_ntz, v double").repartition(3)
    got = enrich.asof_calendar(ls, rs, ["v"], zones.Order(1, rows=256))
    lines = got._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not any("NestedLoop" in x or "Cartesian" in x for x in lines)
    got = {r["id"]: (r["series"], r["ts"], r["v"]) for r in got.collect()}
    assert len(got) == len(left)
    for series, ts, i in left:
        at = None if ts is None or ts < START else min(int((ts - START).total_seconds()), len(right) - 1)
        assert got[i] == (series, ts, None if at is None else right[at][1])
