"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores. Every query runs in full into a sink that
keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

from rubrica.session import local_session

HEADLINE = [
    "leaderboard",
    "leaderboard_edit",
    "per_subcategory",
    "layer_comparison",
    "failure_analysis",
    "failure_analysis_edit",
    "theme_breakdown",
    "filter_rates",
    "per_dimension",
    "collapse_seeds",
    "leaderboard_ci",
    "bootstrap_ci_mean",
    "agreement",
    "annotation_sample",
    "stratified_sample",
    "worst_examples",
    "failure_examples",
    "cost_ledger",
    "cost_summary",
    "prompt_warnings",
    "weighted_score",
    "pending_work",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    from rubrica.plans.catalog import QUERIES

    # One warm-up query, so that class loading is not charged to the first name.
    QUERIES["covered_mask"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "evaluation_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
