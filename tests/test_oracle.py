"""Every registered query against its SQL, over many small zones and with the joins of large tables."""

import math
import os
import re

import numpy as np
import pytest
from compare import connect, difference

from tidebar import catalogue
from tidebar.catalogue.evaluation import MODELS, wide_predictions
from tidebar.operators import evaluate as E
from tidebar.operators import models as M
from tidebar.operators import weights as W

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
catalogue.load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(name, spark, tiny_zones, no_broadcast, con):
    df = catalogue.QUERIES[name](spark, SF)
    check_plan(df._jdf.queryExecution().executedPlan().toString().splitlines())
    assert difference(df, con, catalogue.ORACLES[name]) is None


def check_plan(lines):
    """No cross join, no broadcast beyond Spark's own size check, no window over all rows in one task."""
    for i, line in enumerate(lines):
        assert not any(o in line for o in ("CartesianProduct", "BroadcastNestedLoopJoin")), line
        # only tables keyed by configured models, horizons and timeframes are broadcast outright
        if "BroadcastHashJoin" in line:
            assert re.search(r"BroadcastHashJoin \[((model|horizon|timeframe)#\d+(, )?)+\]", line), line
        # the table of row counts per time range of a single series is small; rows themselves never qualify
        if "- Window [" in line and not any(c in line for c in ("_bucket", "_t_")):
            assert not any("Exchange SinglePartition" in below for below in lines[i + 1 : i + 3]), line


# The sequence models need more rows than the smallest tables have in their last quarter.
MODEL_SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_has_rows(name, spark):
    rows = catalogue.QUERIES[name](spark, MODEL_SF).collect()
    assert rows
    for row in rows:
        assert all(v is not None for v in row.asDict().values()), row


def test_models_learn_a_learnable_series(spark):
    """On a wave the next value follows from the lags: every model must explain most of it."""
    rows = [(math.sin(i / 7), math.sin((i - 1) / 7), math.sin((i + 1) / 7)) for i in range(600)]
    df = spark.createDataFrame(rows, "now double, before double, target double").repartition(2)
    for name, build in M.BASE_MODELS.items():
        model = M.train_or_tune(df, build(trees=20, depth=5), ("now", "before"), {"maxDepth": 5}, {})
        rmse = model.transform(df).agg(E.error_metrics("target", "prediction")["rmse"].alias("rmse")).first()["rmse"]
        assert rmse < 0.35 * math.sqrt(0.5), (name, rmse)


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) * [1, 5, 0.2] + 3
    y = x @ [2.0, -1.0, 4.0] + rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, target double")
    xc, yc = x - x.mean(0), y - y.mean()
    for alpha in (0.0, 1.0, 30.0):
        fit = M.ridge_meta(df, ["a", "b", "c"], alpha=alpha).stages[-1]
        want = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
        np.testing.assert_allclose(fit.coefficients.toArray(), want, rtol=1e-8)
        np.testing.assert_allclose(fit.intercept, y.mean() - x.mean(0) @ want, rtol=1e-8)


def test_refined_weights_beat_the_grid_and_every_model(spark):
    rows = wide_predictions(spark, SF, (24,)).cache()
    coarse = W.optimise_weights(rows, MODELS, "mae").first()
    fine = W.optimise_weights(rows, MODELS, "mae", finer=5).first()
    single = [rows.agg(E.error_metrics("actual", m)["mae"].alias("mae")).first()["mae"] for m in MODELS]
    assert abs(sum(fine[f"w_{m}"] for m in MODELS) - 1) < 1e-9
    assert fine["mae"] <= coarse["mae"] + 1e-9 <= min(single) + 2e-9
    rows.unpersist()
