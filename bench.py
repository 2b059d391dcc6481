"""Wall time of the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 BENCH_RUNS=3 python bench.py

Each query runs once to warm up and then BENCH_RUNS times; the median counts.
Results go to Spark's no-op sink, so every row and column is produced and
nothing is sent to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabloom.plans import QUERIES
from tabloom.session import build_session

HEADLINE = [
    "word_freq_topk", "word_freq", "word_freq_ws", "word_metrics", "vocab_df", "count_vectors",
    "clean_facts", "all_rollups", "by_genre", "by_rating_bin", "pct_of_total",
    "movie_envelope", "analytics_envelope", "route_subscriptions", "dead_letter", "publish_stats", "rate_window",
    "pop_stats", "histogram", "qcut", "cut_equal_width", "classification_report", "roc_points", "auc",
    "interp_join", "divided_diff", "trapezoid", "poly_fit", "matmul_coo", "sample_exact", "nb_multinomial", "linreg",
    "stream_movie_events",
]


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g",
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name:28s} {times[name]:7.3f}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "runs": runs,
                "shuffle_partitions": int(cpus),
            }
        )
    )
    return 0


if __name__ == "__main__":
    sys.exit(main())
