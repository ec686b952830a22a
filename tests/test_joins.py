"""Joins of uneven keys."""

import random

from pyspark.sql import functions as F

from tidebar import catalogue
from tidebar.plans.joins import join_frequent
from tidebar.sources import store as K

catalogue.load_all()


def test_frequent_keys_are_joined_apart(spark):
    r = random.Random(1)
    keys = ["the"] * 4000 + ["of"] * 2000 + [f"w{r.randrange(3000)}" for _ in range(4000)] + [None] * 50
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, token string").repartition(6)
    table = spark.createDataFrame([("the", 1.0), *((f"w{i}", float(i)) for i in range(0, 3000, 2)), (None, 9.0)], "token string, polarity double")
    got = join_frequent(rows, table, "token", 50)
    want = rows.join(table, "token")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "IN (the,of)" in plan
    even = rows.where(F.col("token").startswith("w"))
    assert sorted(map(tuple, join_frequent(even, table, "token", 50).collect())) == sorted(map(tuple, even.join(table, "token").collect()))
    assert join_frequent(rows.limit(0), table, "token").count() == 0


def test_moderately_frequent_keys_are_joined_apart_too(spark):
    """A key with one row in 2,000: above one in 10,000, so that fewer rows are shuffled."""
    rows = spark.range(20_000).selectExpr("id", "if(id % 2000 = 0, 'often', concat('w', id)) AS token").repartition(3)
    table = rows.select("token").distinct().selectExpr("token", "length(token) AS polarity")
    got = join_frequent(rows, table, "token")
    assert "IN (often)" in got._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(table, "token").collect()))


def test_sentiment_is_joined_once_for_all_appends(spark, tmp_path, monkeypatch):
    r = random.Random(2)
    texts = [" ".join(f"w{chr(97 + r.randrange(20))}" for _ in range(r.randrange(9))) for _ in range(30)] + [None, "", "one two one"]
    docs = [(i, t, "en", "s") for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    plans, append = [], K.append_sentiment
    monkeypatch.setattr(K, "append_sentiment", lambda score, *args: plans.append(score._jdf.queryExecution().executedPlan().toString()) or append(score, *args))
    rows = catalogue.QUERIES["append_sentiment"](spark, str(tmp_path)).collect()
    mean = catalogue.QUERIES["mean_sentiment"](spark, str(tmp_path)).first()
    assert len(rows) == 2 and len({r["timestamp"] for r in rows}) == 2 and {r["score"] for r in rows} == {mean["avg_sentiment"]}
    assert len(plans) == 2 and not any("Join" in p for p in plans)
