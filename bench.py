"""Time the headline queries: one JSON line on stdout.

Inputs that ingest stores (bars, indicator frames) are timed as their own
entries, ``store:*``, and not inside the queries that read them.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidebar import catalogue  # noqa: E402
from tidebar.catalogue.cleaning import frame  # noqa: E402
from tidebar.catalogue.learning import training  # noqa: E402
from tidebar.plans import inputs  # noqa: E402
from tidebar.session import local_session  # noqa: E402

STORES = {
    "bars_5m_all": inputs.bars_5m_all,
    "bars_15m_all": inputs.bars_15m_all,
    "bars_h": inputs.bars_h,
    "bars_h_all": inputs.bars_h_all,
    "bars_d": inputs.bars_d,
    "bars_d_all": inputs.bars_d_all,
    "bars_d_flag": inputs.bars_d_flag,
    "macro": inputs.macro,
    "lexicon": inputs.lexicon,
    "frame_h": frame,
    "training_h": training,
}
HEADLINE = (
    "build_bars build_bars_daily build_bars_composite_order sliding_bars multi_timeframe_bars atm_iv_summary "
    "title_sentiment append_dedup ffill fill_chain head_tail interpolate_linear dedup_precedence year_of_15min "
    "asof_enrich asof_enrich_keyed ewm ema_pair rsi bollinger adx mfi indicator_frame signal_counts signal_counts_daily "
    "moving_averages multi_horizon_targets sequences walk_forward expanding_daily metrics_by_model_horizon "
    "classification_metrics optimise_weights ridge_meta backtest_metrics strategy_summary signal_trades "
    "random_forest stream_bars"
).split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    catalogue.load_all()
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name, build in STORES.items():
        start = time.perf_counter()
        build(spark, sf)
        times[f"store:{name}"] = round(time.perf_counter() - start, 3)
    for name in names:
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall-clock of the headline queries and the stores they read",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
