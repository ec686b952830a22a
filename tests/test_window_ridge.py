"""The window regression against one fitted to windows that are built."""

import datetime as dt

import numpy as np
import pytest

from tidebar.operators.window_ridge import window_ridge
from tidebar.plans import zones

START = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("rows, length, steps", [(32, 6, 3), (64, 48, 26), (4096, 12, 1)])
def test_equal_to_a_design_matrix(spark, rows, length, steps):
    r = np.random.default_rng(4)
    data = {}
    for series, n in (("a", 600), ("b", 230), ("short", 20)):
        x = np.cumsum(r.normal(size=(n, 3)) * [1, 0.3, 2], axis=0)
        data[series] = (x - x.min(0)) / (x.max(0) - x.min(0))
    listed = [(s, START + dt.timedelta(hours=i), *map(float, v)) for s, x in data.items() for i, v in enumerate(x)]
    df = spark.createDataFrame([*listed, (None, START, 1.0, 1.0, 1.0), ("a", None, 1.0, 1.0, 1.0)], "series string, ts timestamp_ntz, f double, g double, close double").repartition(3)
    got = window_ridge(df, zones.Order(3600, rows=rows), ("f", "g", "close"), length, steps, alpha=0.7).toPandas()
    assert set(got["series"]) == ({"a", "b", "short"} if length + steps < 15 else {"a", "b"})
    for series, part in got.groupby("series"):
        x, n = data[series], len(data[series])
        cut, ends = int(n * 0.75), np.arange(length - 1, n - steps)
        design = np.stack([x[t - length + 1 : t + 1][::-1].ravel() for t in ends])
        y = x[ends + steps, 2]
        train = ends < cut - steps
        xc, yc = design - design[train].mean(0), y - y[train].mean()
        w = np.linalg.solve(xc[train].T @ xc[train] + 0.7 * np.eye(xc.shape[1]), xc[train].T @ yc[train])
        want = y[train].mean() + xc @ w
        kept = train | (ends >= cut)
        part = part.sort_values("row")
        assert part["row"].tolist() == ends[kept].tolist()
        assert part["split"].tolist() == np.where(train, "train", "test")[kept].tolist()
        np.testing.assert_allclose(part["predicted"], want[kept], rtol=1e-7, atol=1e-8)
        np.testing.assert_allclose(part["actual"], y[kept])
