"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``: median of three warm runs.

Prints one JSON line. Results are consumed by the ``noop`` sink, so every row is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import time

import catalogue
from lexframe.session import local_session

HEADLINE = [
    "pair_turns", "session_context", "search_history", "merge_articles", "exact_lookup",
    "vector_topk", "scoped_topk", "tiered_retrieve", "route_questions", "extract_citations",
    "verify_citations", "strip_markup", "qa_report", "nearest_rank", "request_counters",
    "latency_histogram", "active_requests", "check_responses", "assemble_answer",
    "extract_articles", "approx_topk",
]
RUNS = 3


def seconds(fn, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    every = catalogue.all_queries()
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    timed = {}
    for name in names:
        seconds(every[name], spark, sf_dir)
        runs = [seconds(every[name], spark, sf_dir) for _ in range(RUNS)]
        timed[name] = round(statistics.median(runs), 3)
    print(json.dumps({
        "metric": "total_median_seconds", "value": round(sum(timed.values()), 3), "unit": "sec",
        "queries": timed, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
