"""Times the headline queries and prints one JSON line.

Each query runs once to warm up and then three times; the median counts. Results go to Spark's no-op
sink, so every row and column is computed and none travels to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from wardline.plans.catalog import QUERIES
from wardline.session import build_session

HEADLINE = (
    "rule_hits", "structural_signals", "minimize_strict_corpus", "classify_links", "retrieve", "screen_report", "screen_all",
    "reputation_hits", "draft_qa", "admit", "user_sessions", "rule_usefulness", "collect_metrics",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cores}]",
        **{
            "spark.sql.shuffle.partitions": cores,
            # Each text table of the test data is one row group in one file, hence one task otherwise.
            "spark.wardline.partitions": cores,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    seconds = {}
    for name in names:
        runs = []
        for _ in range(4):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cores),
            }
        )
    )


if __name__ == "__main__":
    main()
