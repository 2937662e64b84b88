"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from lumenframe.plans.queries import QUERIES
from lumenframe.session import session

HEADLINE = (
    "select_stats_weighted",
    "where_all_any",
    "scan_stats",
    "compensated_sum",
    "quantile_type7",
    "median_by_priority",
    "standard_deviation",
    "covariance_sample",
    "join_left_1to1",
    "histogram_inclusive",
    "even_row_sample",
    "sort_stable",
    "text_encodings",
    "text_numbers",
    "math_functions",
    "vector_functions",
    "matrix_gram",
    "electrical",
    "linear_fit",
    "baseline_compare",
    "ledger_chain_check",
    "bootstrap_mean",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", spark_master=f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_ui_enabled="false", spark_driver_memory="12g", spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES[HEADLINE[0]](spark, folder).collect()  # starts the JVM's and the workers' engines
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(name, seconds[name], file=sys.stderr)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
