"""Headline queries, timed: one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores.

Each query runs to the end (all result rows are produced and thrown away); times include all fitting the
query does. Before that the session, the Python workers, their libraries and the forest are warmed up on
three queries, whose times do not count.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from flowbench import catalog  # noqa: E402

HEADLINE = (
    "cleaned_split_summary", "parse_stage", "clean_stage", "split_counts", "variant_shapes",
    "variant_pipeline_parse_norm_clean", "impute_median", "lineitem_medians", "standard_scale",
    "column_transformer", "quantile_threshold", "flag_anomalies", "metrics_record",
    "ranking_metrics_lineitem", "csv_scan", "csv_encoding", "csv_types", "csv_quoted", "one_hot_wide", "svd_features",
    "svd_features_wide", "rff_features", "rotation_expand", "rf_anomaly_scores", "rf_anomaly_run",
    "model_roundtrip", "run_summary",
)
WARM_UP = ("cleaned_split_summary", "rff_features", "rf_scored_counts")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("flowbench-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in WARM_UP:
        catalog.QUERIES[name](spark, folder).collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(os.path.normpath(folder)).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": scale,
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
