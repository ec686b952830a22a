"""Run registered queries against their SQL: ``python tests/check.py [names or prefixes]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import importlib  # noqa: E402

from compare import connect, difference  # noqa: E402

from tidebar import catalogue  # noqa: E402
from tidebar.session import local_session  # noqa: E402


def main() -> None:
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    if os.environ.get("MODULES"):
        for m in os.environ["MODULES"].split(","):
            importlib.import_module(f"tidebar.catalogue.{m}")
    else:
        catalogue.load_all()
    spark = local_session(os.environ.get("CPUS", "8"))
    spark.sparkContext.setLogLevel("OFF")
    if os.environ.get("ZONE_ROWS"):
        spark.conf.set("spark.tidebar.zoneRows", os.environ["ZONE_ROWS"])
    con = connect(sf)
    want = sys.argv[1:]
    bad = []
    for name, fn in catalogue.QUERIES.items():
        if want and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in want):
            continue
        t = time.time()
        try:
            sql = catalogue.ORACLES.get(name)
            df = fn(spark, sf)
            if sql is None:
                message, note = None, f"rows only: {df.count()}"
            else:
                message, note = difference(df, con, sql), "ok"
        except Exception:
            message = traceback.format_exc(limit=-2)[-900:]
        print(f"{'FAIL' if message else 'pass'} {name} {time.time() - t:.1f}s {message or note}", flush=True)
        if message:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}")
    spark.stop()


if __name__ == "__main__":
    main()
