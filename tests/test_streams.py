"""Sinks of micro-batches: any order of arrival, repeated batches and copies give what one batch would."""

import collections
import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.plans.zones import Order
from tidebar.session import new_path
from tidebar.streaming import streams as S

START = dt.datetime(2024, 1, 1)
SCHEMA = "series string, ts timestamp_ntz, value double, id long"


@pytest.fixture(scope="module")
def deliveries():
    """Rows mostly in order; some come much later, one series starts late, one delivery is empty."""
    r = random.Random(11)
    rows = [("a", START + dt.timedelta(minutes=7 * i), r.uniform(1, 9), i) for i in range(900)]
    rows += [("b", START + dt.timedelta(minutes=7 * (i // 3)), r.uniform(1, 9), 5000 + i) for i in range(500, 700)]
    out = [[] for _ in range(5)]
    for i, row in enumerate(rows):
        k = min(3, row[3] * 4 // 900) if row[0] == "a" else 2
        out[4 if r.random() < 0.05 else k + (k > 1 and r.random() < 0.02)].append(row)
    return rows, [*out[:2], [], *out[2:]]


def test_means_equal_those_of_one_batch(spark, deliveries):
    rows, parts = deliveries
    path, order = new_path(spark, "means"), Order(420, ties=("id",), rows=64)
    lost = [("a", None, 1.0, -1), (None, START, 2.0, -2), ("a", START, None, -3)]
    for k, part in enumerate(parts):
        batch = spark.createDataFrame([*part, *(lost if k == 1 else [])], SCHEMA)
        for _ in range(1 + (k in (1, 4))):  # a batch may be tried twice
            S.revise_means(batch, k, path, {"fast": 3, "slow": 40}, order, zone_seconds=6 * 3600)
    got = S.revised_means(spark, path).toPandas().sort_values(["series", "ts", "id"]).reset_index(drop=True)
    want = pd.DataFrame(rows, columns=["series", "ts", "value", "id"]).sort_values(["series", "ts", "id"]).reset_index(drop=True)
    assert got[["series", "ts", "value", "id"]].equals(want[["series", "ts", "value", "id"]].astype(got[["series", "ts", "value", "id"]].dtypes))
    for name, span in (("fast", 3), ("slow", 40)):
        np.testing.assert_allclose(got[name], want.groupby("series")["value"].transform(lambda x: x.ewm(span=span, adjust=False).mean()), rtol=1e-11)
    assert spark.read.parquet(f"{path}/rows").count() == len(rows) + len(lost)


def test_only_touched_zones_are_computed_again(spark):
    path, order = new_path(spark, "touched"), Order(3600, ties=("id",))
    day = lambda d, n: [("a", START + dt.timedelta(days=d, hours=h), float(h), d * 24 + h) for h in range(n)]
    for k, part in enumerate([day(0, 24) + day(1, 24), day(2, 24), day(1, 1)]):
        S.revise_means(spark.createDataFrame(part, SCHEMA), k, path, {"m": 9}, order)
    written = spark.read.parquet(f"{path}/means").groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in written] == [48, 24, 49]


def test_bars_are_revised(spark, deliveries):
    rows, parts = deliveries
    path = new_path(spark, "bars")
    for k, part in enumerate(parts):
        for _ in range(1 + (k == 3)):
            S.revise_bars(spark.createDataFrame(part, SCHEMA), k, path, "1 hour", "value", ("id",))
    got = {(r["series"], r["ts"]): tuple(r[2:]) for r in S.revised_bars(spark, path).collect()}
    bars = collections.defaultdict(list)
    for series, ts, value, i in rows:
        bars[series, ts.replace(minute=0)].append((ts, i, value))
    want = {}
    for key, ticks in bars.items():
        x = [v for *_, v in sorted(ticks)]
        want[key] = (x[0], max(x), min(x), x[-1], len(x))
    assert got == want


def test_copies_meet_across_batches(spark, deliveries):
    rows, parts = deliveries
    path = new_path(spark, "once")
    for k, part in enumerate(parts):
        for _ in range(2):
            S.append_once(spark.createDataFrame(part + part + (parts[0] if k else []), SCHEMA), k, path, ["id"])
    schema = spark.createDataFrame([], SCHEMA).schema
    assert sorted(map(tuple, S.appended(spark, path, schema).collect())) == sorted(rows)
    assert S.appended(spark, new_path(spark, "nothing"), schema).where(F.lit(True)).count() == 0
