"""Properties of the physical plans that matter at scale."""

import re

from tidebar.operators import clean as C
from tidebar.operators.ewm import ewm
from tidebar.plans import inputs as I
from tidebar.plans import zones
from tidebar.session import new_path
from tidebar.sources import bars as B

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bars_use_a_hash_aggregate_with_a_partial_step(spark):
    text = plan(B.build_bars(I.ticks(spark, SF), "1 hour", ids=("event_id",)))
    assert "SortAggregate" not in text and text.count("HashAggregate") == 2 and text.count("Exchange") == 1
    assert re.search(r"ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string,value:double>", text)


def test_series_are_split_by_zone_and_rows_shuffled_once(spark):
    order = zones.HOURLY
    text = plan(zones.over(I.bars_h(spark, SF), order, before=1, x=lambda w: C.F.lag("close").over(w)))
    rows = [line for line in text.splitlines() if "Exchange hashpartitioning" in line and "_zone" in line]
    assert len(rows) == 1


def test_carries_keep_the_row_partitioning(spark, no_broadcast):
    """The rows are shuffled by zone once per branch; the carry joins without another shuffle of them."""
    text = plan(ewm(I.bars_h(spark, SF), zones.HOURLY, {"m": ("close", 9)}))
    assert not [line for line in text.splitlines() if "Exchange hashpartitioning" in line and "_cell" in line]


def test_timeframe_is_a_partition_filter(spark):
    path = new_path(spark, "tf")
    B.multi_timeframe_bars(I.bars_5m_all(spark, SF)).write.partitionBy("timeframe").parquet(path)
    text = plan(B.select_timeframe(spark.read.parquet(path), "1hr"))
    assert re.search(r"PartitionFilters: \[.*timeframe.*1h", text)


def test_head_and_tail_limit_before_the_shuffle(spark):
    text = plan(C.head_tail(I.bars_h(spark, SF), 3))
    assert text.count("WindowGroupLimit") >= 4
