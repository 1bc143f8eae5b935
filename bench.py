"""Benchmark: run the headline queries at ``$BENCH_SF_DIR`` on
``local[$BENCH_CPUS]`` and print one JSON line.

Each query is forced to completion with the ``noop`` sink (every column
computed, nothing collected to the driver).  A warm-up query runs first so
JVM start-up is not charged to the first query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "chunk_windows",
    "chunk_recursive",
    "dedup_chunks",
    "topk_keyword",
    "semantic_search",
    "topk_semantic",
    "topk_hybrid",
    "eval_set",
    "build_prompt",
    "retrieval_metrics",
    "monitor_summary",
    "stream_chunks",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from docloom.plans import catalog
    from docloom.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16)
    # warm-up on the smallest tables: JVM code paths, regex, Python workers
    # (Arrow jobs), parquet readers.  Start-up is not charged to a query.
    smoke = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    for name in ("chunk_rows", "topk_semantic", "topk_keyword"):
        catalog.QUERIES[name](spark, smoke if os.path.isdir(smoke) else sf_dir).write.format("noop").mode(
            "overwrite"
        ).save()

    timings = {}
    for name in names:
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
    spark.stop()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(m.group(1)) if m else None,
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
