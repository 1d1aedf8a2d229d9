"""Wall time of the headline queries, one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the cores; BENCH_QUERIES names other queries, or "all".
"""

from __future__ import annotations

import json
import os
import sys
import time

from taufold.queries import REGISTRY
from taufold.session import local_session

HEADLINE = (
    "smd_balance",
    "labelled_records",
    "groups_with_flags",
    "page_terms",
    "frequent_terms",
    "fill_with_mode",
    "quantile_bin_lines",
    "price_percentiles_by_counting",
    "repeated_rows",
    "value_boxes",
    "weight_summaries",
    "dr_scores_two_arms",
    "average_effects",
    "subgroup_effects",
    "blp_two_arms",
    "calibration_line",
    "calibration_scores",
    "qini_curve",
    "uplift_coefficients",
    "uniform_bands",
    "combined_tests",
    "effect_rank",
    "targeting_points",
    "top_tenth_subgroups",
    "classification_metrics",
    "linear_projection",
    "propensity_weights",
    "cross_fitted_effects",
    "residual_forest",
    "bagged_trees",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(REGISTRY) if asked == "all" else asked.split() or list(HEADLINE)
    spark = local_session(cores=cpus, name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    # Load the engine's classes before the clock; every timed query still starts from the given files.
    REGISTRY["arm_summary"].run(spark, sf_dir).collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    line = {
        "metric": "total_wall_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
    }
    print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
