"""Headline queries, timed.  Prints one JSON line.

Inputs (the derived raw tables) are written before the clock starts; each query
is planned and run to completion, result discarded, and the best of two runs
counts.  Settings: BENCH_SF_DIR, BENCH_CPUS.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import fixtures as X  # noqa: E402
from catalog.queries import QUERIES  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else [
    "b13_normalize", "d1_dedup_by_link", "case5_search", "e2_search_batch", "e3_details_batch", "l2_slots_batch",
    "l4_adjudicate", "g1_intent_lookback", "g2_history_block", "g5_transcript_at", "g6_resolve_attempts",
    "j9_classify_steps", "j10_summarize_traces", "o1_check_tool_path", "o2_check_grounding",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("roomtrace-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for build in (X.raw_listings, X.search_requests, X.booking_requests, X.turns, X.steps, X.attempts, X.listings, X.listings_by_id, X.decisions):
        build(spark, sf_dir)
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
