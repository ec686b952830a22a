"""Regressions from merged moments against numpy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.operators import moments
from tidebar.operators import splits as V
from tidebar.plans import zones
from tidebar.session import stage

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def walk(spark):
    """Two random walks, one short; a feature that repeats another, a constant one, missing values."""
    r = np.random.default_rng(3)
    rows = []
    for series, n in (("a", 700), ("b", 60)):
        close = 1e5 + np.cumsum(r.normal(size=n))
        for i in range(n):
            rows.append((series, START + dt.timedelta(minutes=15 * i), float(close[i]) if i % 50 != 7 else None, float(r.normal())))
    return spark.createDataFrame(rows, "series string, ts timestamp_ntz, close double, x double").cache()


def groups(df):
    return {k: g.sort_values("ts").reset_index(drop=True) for k, g in df.toPandas().groupby("series")}


@pytest.mark.parametrize("rows", [16, 100, 4096])
def test_moments_and_coefficients_of_all_rows_so_far(walk, rows):
    order = zones.Order(900, rows=rows)
    z = zones.enter(walk, order).withColumns({"twice": 2 * F.col("x") + 1, "one": F.lit(5.0), "sq": F.col("x") * F.col("x")})
    x = ["x", "twice", "one", "sq"]
    fitted = moments.running_moments(z, order, [*x, "close"], F.floor(F.col("_pos") / 13), {"_end": F.max("_pos")})
    got = moments.coefficients(fitted, x, "close").where("(_end + 1) % 13 = 0").toPandas()
    assert set(got["series"]) == {"a", "b"} and len(got) == 700 // 13 + 60 // 13
    for _, r in got.iterrows():
        g = groups(walk)[r["series"]].iloc[: r["_end"] + 1].dropna()
        assert r["_n"] == len(g)
        a = np.column_stack([np.ones(len(g)), g["x"], g["x"] ** 2])
        want = np.linalg.lstsq(a, g["close"].to_numpy() - 1e5, rcond=None)[0]
        np.testing.assert_allclose([r["_b"] - 1e5, r["_b_x"], r["_b_sq"]], want, rtol=1e-6, atol=1e-7)
        assert r["_b_twice"] == 0 and r["_b_one"] == 0
        np.testing.assert_allclose(r["_c_x_close"], ((g["x"] - g["x"].mean()) * (g["close"] - g["close"].mean())).sum(), rtol=1e-7, atol=1e-6)


def test_ridge_and_too_few_rows(walk):
    order = zones.Order(900, rows=32)
    fitted = moments.running_moments(zones.enter(walk, order), order, ["x", "close"], F.col("_pos"), {"_end": F.max("_pos")})
    got = moments.coefficients(fitted, ["x"], "close", ridge=3.0).where("series = 'b'").orderBy("_end").toPandas()
    g = groups(walk)["b"].dropna()
    x, y = g["x"] - g["x"].mean(), g["close"] - g["close"].mean()
    np.testing.assert_allclose(got["_b_x"].iloc[-1], (x * y).sum() / ((x * x).sum() + 3), rtol=1e-9)
    assert got["_b_x"].isna().tolist()[:3] == [True, False, False] and got["_b"].isna()[0]


@pytest.mark.parametrize("rows", [32, 4096])
def test_walk_forward_uses_nothing_later(walk, rows):
    order = zones.Order(900, rows=rows)
    features = {"f": lambda w: F.col("close"), "g": lambda w: F.lag("x", 2).over(w)}
    got = V.walk_forward_features(walk, order, features, 2, {"h4": 4, "h9": 9}, every=10, history=20).toPandas()
    daily = V.expanding_daily_features(walk, order, features, 2, {"h4": 4, "h9": 9}, day_rows=24, least=4).toPandas()
    assert len(got) > 50 and len(daily) > 200

    def forecast(g, known, at, h):
        t = np.arange(h, known)
        x = np.column_stack([np.ones(len(t)), g["close"].to_numpy()[t - h] - 1e5, g["x"].shift(2).to_numpy()[t - h]])
        y = g["close"].to_numpy()[t] - 1e5
        ok = ~np.isnan(x).any(axis=1) & ~np.isnan(y)
        b = np.linalg.lstsq(x[ok], y[ok], rcond=None)[0]
        return 1e5 + b @ [1, g["close"][at] - 1e5, g["x"].shift(2)[at]]

    for _, r in got.iterrows():
        g, h = groups(walk)[r["series"]], int(r["horizon"][1:])
        np.testing.assert_allclose(r["predicted"], forecast(g, r["origin"] + 1, r["origin"], h), rtol=1e-9)
        assert r["actual"] == g["close"][r["origin"] + h]
    for _, r in daily.iloc[::17].iterrows():
        g, h = groups(walk)[r["series"]], int(r["horizon"][1:])
        np.testing.assert_allclose(r["predicted"], forecast(g, r["day"] * 24, r["row"], h), rtol=1e-9)
        assert r["actual"] == g["close"][r["row"] + h] and 0 <= r["row"] - r["day"] * 24 < h


def test_long_series_keeps_its_digits(spark):
    """A slope far below the noise after a million rows (1e-14 to 8e-13 were measured up to ten million)."""
    n, order = 1_000_000, zones.Order(1)
    ts = F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)")
    close = F.pmod(F.xxhash64("id"), F.lit(1000003)) / 1000 + 500 + F.col("id") * 3e-7
    df = stage(spark.range(n).select(F.lit("a").alias("series"), ts.alias("ts"), "id", close.alias("close")), "long")
    z = zones.enter(df, order)
    end = moments.running_line(z, order, "close", F.floor(F.col("_pos") / 250_000), {"_end": F.max("_pos")}).where(f"_end = {n - 1}").first()
    y = df.select("id", "close").toPandas().sort_values("id")["close"].to_numpy().astype(np.longdouble)
    x = np.arange(n, dtype=np.longdouble) - (n - 1) / 2
    slope = (x * (y - y.mean())).sum() / (x * x).sum()
    assert end["_n"] == n and abs(end["_b__x"] - slope) < 1e-12 * abs(slope)
