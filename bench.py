"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from lectern import catalog

HEADLINE = [
    "result_analytics", "metric_means", "weighted_composites", "score_distribution", "dense_model_stats", "heatmap_page", "failure_groups", "representative_failure",
    "required_pairs", "response_costs", "terminal_metrics", "vector_top_k", "vector_neighbours", "published_hash", "ordered_evidence", "carried_headings", "canonical_blobs",
    "set_differences", "latest_per_job", "html_chunks",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = {n: catalog.queries()[n] for n in HEADLINE}
    times: dict[str, float] = {}
    for name, query in runs.items():
        took = []
        for _ in range(3):  # the first run compiles; the median of three counts
            began = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        times[name] = round(statistics.median(took), 3)
    print(json.dumps({"metric": "headline queries, median of 3", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
