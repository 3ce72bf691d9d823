"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the folder of the driver tables, BENCH_CPUS the local cores.
Each query is built, planned and run to the end (rows are produced and dropped);
the time of the second of two runs counts, so start-up costs stay out.
"""

from __future__ import annotations

import json
import os
import sys
import time

from areaspark.queries import load
from areaspark.session import local_session

HEADLINE = [
    "agg_sum_strict", "pivot_wider", "agg_rollup_all", "win_group_total", "win_row_number_ordered",
    "join_nullsafe_sql", "join_valid_time", "apportion_crosswalk", "stack_levels", "theme_race",
    "theme_age_gender", "share_interpolate", "deprivation_city", "deprivation_place", "bench_mean_min_max",
    "zscore_halfscale", "rates_wide_2021", "cohort_registry", "cohort_admissions", "flag_condition",
    "spatial_join_inner", "spatial_two_stage", "admission_totals", "parse_pharmacy_names", "dataset_final",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, "areaspark-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = load.queries()
    wanted = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for key in wanted:
        for _ in range(2):
            start = time.perf_counter()
            queries[key](spark, folder).write.format("noop").mode("overwrite").save()
            times[key] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total_sec",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(os.path.normpath(folder)),
            }
        )
    )


if __name__ == "__main__":
    main()
