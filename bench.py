"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local threads, BENCH_RUNS the
timed runs per query (median). Every run starts without shared results.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerline.plans import load  # noqa: E402
from ledgerline.registry import forget_staged  # noqa: E402
from ledgerline.session import build_session  # noqa: E402

HEADLINE = [
    "E01_journey_report", "A01_group_sum", "A07_dense_grid", "A12_linear_quantile", "A15_weighted_quantile", "A25_proportional_allocation", "A36_multi_level_counters",
    "J01_inner_join", "J10_backward_asof", "J11_earliest_arrival", "J12_interval_join", "J13_nearest_with_tolerance", "J27_segment_expansion",
    "W01_entry_exit_pairing", "W04_barrier_pairing", "W06_transitive_stitching", "W18_gap_completion", "T03_top_one_per_group", "T05_suppression",
    "R03_bag_difference", "G04_pulse_detector", "G07_best_lag", "N01_connected_components", "B02_failure_choice", "B06_posterior", "X07_poisson_bootstrap", "V02_headway_conflicts",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("OFF")
    table = load()
    times = {}
    for name in HEADLINE:
        spent = []
        for _ in range(runs + 1):  # the first run warms up
            forget_staged()
            t0 = time.perf_counter()
            table[name](spark, sf).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(spent[1:]), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
