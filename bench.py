"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each query is run to the end (a no-op sink, no rows to the driver); BENCH_RUNS > 1 takes the median.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from veritally.plans import catalog
from veritally.plans.session import local_session

HEADLINE = os.environ.get("BENCH_QUERIES", "").split() or ["mentions_all", "verify_corpus", "bm25_topk", "cosine_topk", "outline", "item_numbering", "archive_diff"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    times = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(os.path.basename(folder).removeprefix("sf") or 0),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
