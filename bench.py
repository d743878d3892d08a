"""Wall time of the headline queries; prints one JSON line.

Settings: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_RUNS (timed runs of the quick queries, after a warm-up).
Each run builds the query anew and writes its whole result to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from visitloom.plans.registry import QUERIES
from visitloom.sources.session import build_session

QUICK = ["funnel", "sessionize", "core_totals", "quality_report", "split_summary", "early_features", "label_after_horizon",
         "nb_scores", "model_metrics_nb", "decile_lift_nb", "calibration_nb", "lift_ntile_nb", "segment_metrics",
         "hash_encode", "experiment_outcomes", "feature_drift"]
FITTED = ["logistic_metrics", "compare_models", "early_logistic_eval", "early_gbt_scores"]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    settings = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
                "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"}
    spark = build_session(f"local[{cpus}]", "bench", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in QUICK:
        run(spark, name, sf_dir)
        seconds[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 3)
    for name in FITTED:
        seconds[name] = round(run(spark, name, sf_dir), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "runs": runs, "settings": settings}))
    spark.stop()


if __name__ == "__main__":
    main()
