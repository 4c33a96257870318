"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

import catalog  # noqa: E402
from faultsift.session import configure  # noqa: E402

HEADLINE = [
    "failure_records", "failure_report", "fetch_counts", "workitems_by_test",
    "sample_tests_per_pattern", "nearest_anchor", "eps_neighbors", "dbscan_vectors", "tfidf",
    "dbscan_clusters", "tfidf_neighbors", "average_linkage_clusters", "predict_workitems",
    "conversation_sessions", "slot_carry_forward", "history_window", "read_failure_json_dir",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = configure(
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    ).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["filter_not_pass"](spark, folder).count()       # start the JVM's engines
    seconds = {}
    for name in names:
        start = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(folder).name.removeprefix("sf"), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
