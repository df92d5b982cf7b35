"""Time the headline queries and print one JSON line.

BENCH_SF_DIR is the folder of the driver tables, BENCH_CPUS the number of local cores, BENCH_QUERIES an optional
comma-separated choice. Each query is written to the no-op sink, so every row and column is computed. The first
run of a query warms the JVM; the second one counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "timeseries_stride", "scatter_stride", "histogram_numeric", "histogram_per_recording", "column_profile",
    "correlation_matrix", "compare_histogram", "compare_group_stats", "compare_summary", "compare_summary_by_rank",
    "compare_curve", "compare_cdf", "difference_rank", "exact_ks", "bar_average", "box_by_color", "density_2d",
    "group_heatmap", "cohort_histogram", "cohort_histogram2d", "cohort_multi_summary", "cohort_effects", "cohort_tests",
    "state_events", "event_summary", "transition_rates", "cohort_regression", "cohort_correlation", "cohort_components",
    "cohort_spectrum", "cluster_labels", "asof_nearest", "track_join", "gps_pairs", "similar_runs", "course_progress",
    "resampled_series", "signal_offsets",
]


def main() -> None:
    from odolake import build_session
    from odolake.plans import all_queries
    from odolake.session import release_tables

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("odolake-bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8,
                          {"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("OFF")
    queries, _ = all_queries()
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    times: dict[str, float] = {}
    for name in names:
        for _ in range(2):
            started = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - started, 3)
            release_tables(spark)
    spark.stop()
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
