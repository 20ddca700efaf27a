"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. The derived count matrix is written once before
timing, as an analysis reads its saved matrix. Each query then runs warm and whole; the median of
``BENCH_RUNS`` runs counts. With query names as arguments only those are timed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallmat.plans.registry import QUERIES  # noqa: E402
from tallmat.sources import retail  # noqa: E402

HEADLINE = [
    "qc_cells",
    "qc_genes",
    "filter_default",
    "removal_report",
    "norm_global",
    "norm_quantile",
    "hvg_stats",
    "hvg_cv2_desc",
    "hvg_mad_above",
    "to_vectors",
    "de_top10_building",
    "de_all_clusters",
    "pca_explained",
    "kmeans_k6",
    "knn_exact",
    "fuzzy_graph",
    "qc_cells_dense",
    "qc_genes_dense",
    "norm_global_dense",
    "norm_quantile_dense",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    start = time.perf_counter()
    retail.prepare(spark, directory)
    setup = time.perf_counter() - start

    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name}: {seconds[name]} (first {times[0]:.2f})", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total warm seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "setup_sec": round(setup, 3),
                "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
