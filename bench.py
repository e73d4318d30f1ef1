"""Seconds per headline query, warm, median of three; one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from compare import session
from tidemark.plans import catalog

HEADLINE = ["order_flow", "klines", "footprint_levels", "latest_ticks", "spread_signal", "research_features", "coverage_symbols", "lake_quality", "symbol_metrics", "basis"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    out = {}
    for name in HEADLINE:
        times = []
        for _ in range(4):  # the first compiles
            t = time.time()
            catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.time() - t)
        out[name] = round(statistics.median(times[1:]), 3)
    events = spark.read.parquet(f"{sf}/events.parquet").count()
    print(json.dumps({"metric": "sum of headline queries", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": sf, "events_per_sec_order_flow": round(events / out["order_flow"])}))


if __name__ == "__main__":
    main()
