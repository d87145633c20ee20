"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: folder of the tables (default sf0.1).  BENCH_CPUS: local cores (default 8).
BENCH_QUERIES: comma-separated names to time instead of the headline set.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from textvane.catalog.registry import catalog  # noqa: E402

HEADLINE = [
    "pii_type_counts",
    "clean_text",
    "guardrail_verdicts",
    "length_stats",
    "label_distribution",
    "exact_dedup",
    "near_dup_groups",
    "stratified_head_sample",
    "train_test_split",
    "batch_assignment",
    "latency_percentiles",
    "latency_linear_stats",
    "price_linear_stats",
    "rolling_percentiles",
    "rolling_throughput",
    "rolling_kl_drift",
    "running_error_rate",
    "quality_degradation",
    "health_snapshot",
    "circuit_breaker_replay",
    "batch_scoring",
    "classification_report",
    "tfidf_vocabulary",
    "tfidf_weights",
    "token_sequences",
    "stream_metrics",
    "stream_breaker",
    "baseline_logreg",
    "baseline_forest",
    "baseline_svm",
    "fuzzy_dedup_ratio",
    "preprocess_corpus",
    "quality_report",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("textvane-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    entries = catalog()
    spark.read.parquet(f"{folder}/documents.parquet").count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        entries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
