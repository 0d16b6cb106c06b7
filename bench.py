"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8)
choose data and threads. Each query first runs once on the smallest data, so that
what is timed is the query and not the start of the JVM; the timed run covers
planning and the whole result.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cindermap.catalogue import QUERIES  # noqa: E402
from cindermap.session import local_session  # noqa: E402

HEADLINE = (
    "risk_aggregate", "fires_per_1k", "presence_all_years", "incident_blend", "residential_by_tract_counts", "many_to_many",
    "multi_year_outer", "scoped_balscale", "balscale_all", "first_per_incident", "mode_by_group", "distinct_cases", "group_values",
    "coverage_by_state", "summary_statistics", "deciles", "decile_classes", "price_histogram", "central_imputation",
    "near_zero_var", "balanced_bootstrap", "row_numbers", "point_in_polygon", "casualty_outcomes", "weighted_linear_fit",
    "prior_corrected_risk",
)


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    times = {}
    for name in HEADLINE:
        run(spark, name, small if os.path.isdir(small) else folder)
        times[name] = round(run(spark, name, folder), 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
