"""Weight searches against every weighting of the grid and every set of models."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.operators import weights as W


def predictions(seed, n, models, groups=("x", "y")):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        actual = float(r.normal(100, 20)) if i % 31 else None
        given = [actual if actual is not None else 0.0] * models + r.normal(0, 1, models) * np.linspace(1, 8, models) + np.linspace(-2, 2, models)
        given = [float(v) for v in given]
        given[-1] = given[0] if seed % 2 else given[-1]  # two equal models
        if i % 17 == 3:
            given[1] = float("nan") if i % 2 else None
        rows.append((groups[i % len(groups)], actual, *given))
    return rows


def schema(models):
    return "k string, actual double, " + ", ".join(f"m{i} double" for i in range(models))


def brute(rows, weights, metric):
    known = [r for r in rows if r[1] is not None]
    x = np.array([[0.0] * len(r[2:]) if any(v is None or np.isnan(v) for v in r[2:]) else r[2:] for r in known])
    y = np.array([r[1] for r in known])
    scores = []
    for w in weights:
        d = y - x @ w
        mae, rmse = np.abs(d).mean(), np.sqrt((d * d).mean())
        scores.append((round({"mae": mae, "rmse": rmse, "hybrid": (mae + rmse) / 2}[metric], 9), mae, rmse))
    best = min(range(len(weights)), key=lambda i: (scores[i][0], i))
    return weights[best], scores[best]


@pytest.mark.parametrize("metric, models, seed", [("mae", 3, 0), ("mae", 4, 1), ("rmse", 4, 1), ("hybrid", 4, 2), ("mae", 6, 4)])
def test_grid_equals_every_weighting(spark, metric, models, seed):
    rows = predictions(seed, 400, models)
    names = [f"m{i}" for i in range(models)]
    df = spark.createDataFrame(rows, schema(models))
    grid = W.simplex(models, 10) / 10
    assert [tuple(w) for w in grid.tolist()] == sorted(set(map(tuple, grid.tolist())))
    for r in W.optimise_weights(df, names, metric, keys=("k",)).collect():
        w, (score, mae, rmse) = brute([x for x in rows if x[0] == r["k"]], grid, metric)
        np.testing.assert_allclose([r[f"w_{m}"] for m in names], w)
        np.testing.assert_allclose([r["mae"], r["rmse"], r["score"]], [mae, rmse, score], rtol=1e-9)
    if models < 6:
        r = W.optimise_weights(df, names, metric).first()
        np.testing.assert_allclose([r[f"w_{m}"] for m in names], brute(rows, grid, metric)[0])
        assert r.asDict().keys() == {*(f"w_{m}" for m in names), "mae", "rmse", "score"}


def test_refined_grid(spark):
    rows = predictions(8, 300, 3)
    r = W.optimise_weights(spark.createDataFrame(rows, schema(3)), ["m0", "m1", "m2"], "mae", finer=5).first()
    coarse = np.rint(brute(rows, W.simplex(3, 10) / 10, "mae")[0] * 50)
    fine = [w for w in W.simplex(3, 50) if (np.abs(w - coarse) <= 5)[:-1].all()]
    np.testing.assert_allclose([r["w_m0"], r["w_m1"], r["w_m2"]], brute(rows, np.array(fine) / 50, "mae")[0])


def test_few_weightings_are_tried(spark, monkeypatch):
    """Six models have 3,003 weightings; a key is done after a small part of them."""
    tried = []
    real = W._evaluated
    monkeypatch.setattr(W, "_evaluated", lambda e, a, k, s: (tried.append(a.select(F.sum(F.size("ask"))).first()[0]), real(e, a, k, s))[1])
    W.optimise_weights(spark.createDataFrame(predictions(4, 400, 6, ("x",)), schema(6)), [f"m{i}" for i in range(6)], "mae", keys=("k",)).collect()
    assert len(tried) < 40 and sum(tried) < 300


def test_exact_weights_equal_the_best_set(spark):
    for seed in (0, 1, 2, 3):
        rows = predictions(seed, 300, 5)
        got = W.exact_weights(spark.createDataFrame(rows, schema(5)), [f"m{i}" for i in range(5)], keys=("k",)).collect()
        products = {r["k"]: np.array(r["products"]).reshape(5, 5) for r in W.error_products(spark.createDataFrame(rows, schema(5)), [f"m{i}" for i in range(5)], keys=("k",)).collect()}
        for r in got:
            e, least = products[r["k"]], np.inf
            for size in range(1, 6):
                for s in combinations(range(5), size):
                    one = np.linalg.lstsq(e[np.ix_(s, s)], np.ones(size), rcond=1e-12)[0]
                    w = one / one.sum()
                    if (w >= -1e-9).all():
                        least = min(least, float(w @ e[np.ix_(s, s)] @ w))
            w = np.array([r[f"w_m{i}"] for i in range(5)])
            assert abs(w.sum() - 1) < 1e-12 and (w >= 0).all()
            np.testing.assert_allclose(r["rmse"], np.sqrt(least), rtol=1e-9)


def test_without_rows(spark):
    none = spark.createDataFrame([], schema(3))
    names = ["m0", "m1", "m2"]
    assert W.exact_weights(none, names).count() == 0
    assert all(W.optimise_weights(none, names, m).count() == 0 for m in W.METRICS)
    with pytest.raises(ValueError):
        W.optimise_weights(none, names, "mse")
