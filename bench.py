"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query's full plan is executed with the no-op sink (every row computed,
nothing collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewise.registry import QUERIES  # noqa: E402
from tidewise.session import local_session  # noqa: E402

HEADLINE = [
    "backtest_last",       # flagship: rolling-origin backtest of Last
    "union_predictions",   # backtest of three baselines, one job
    "backtest_scores",
    "cv_results",          # cross-validated baselines per segment and horizon
    "train_best",
    "last_forecast",
    "time_folds",
    "horizon_grid",
    "infer_frequency",
    "calendar_features",
    "base_table",
    "impute_numeric",
    "impute_categorical",
    "constant_columns",
    "backtest_report",     # test and training errors of three baselines
    "lag_feature_chunked",
    "base_table_from_files",
    "lead_target_ranged",
    "fold_medians",        # imputation values of all models
    "backtest_month",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          app="tidewise-bench")
    # warm up the JVM (class loading, code generation paths for scans,
    # aggregates and windows) with a query that is not timed
    for warm in ("segments", "lag_feature"):
        QUERIES[warm](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf_name = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    try:
        sf = float(sf_name)
    except ValueError:
        sf = sf_name
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
