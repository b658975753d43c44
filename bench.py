"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pulsegrid.plans import QUERIES
from pulsegrid.session import local_session

HEADLINE = (
    "s03_parse_vector_json", "s10_read_container_stats", "k01_write_points", "f21_process_points", "f27_normalize_threat",
    "p06_ffill", "j01_top_clients", "j03_applicable_rules", "j05_correlate", "j06_inhibit",
    "g01_device_stats", "g03_resample", "g12_federate_p95", "g14_merge_labels", "g19_edge_stats", "g23_running_mean",
    "w01_rolling", "w04_dynamic_threshold", "w05_anomaly_islands", "w14_rate", "w19_held_for",
    "m04_sigma_outliers", "m09_trend_forecast", "m12_performance_trends", "m17_correlations",
    "m01_isolation_forest", "m08_dbscan", "m18_sequence_forecast",
    "t06_alert_lifecycle", "t07_rate_limit", "t09_window_rules", "t12_breaker_states",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores=cpus, shuffle_partitions=cpus, memory="16g")
    # start the JVM's code paths and the Python workers before the clock runs
    spark.range(1000).repartition(cpus).mapInPandas(lambda it: it, "id long").count()
    QUERIES["j01_top_clients"](spark, folder).collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
