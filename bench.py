"""Time the headline queries: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = {
    "rolling_volatility": "w07_rolling_std",
    "digit_counts": "w11_digit_counts",
    "entropy": "w21_entropy_25",
    "digit_streaks": "w15_digit_streak",
    "signal_runs": "w27_run_position",
    "hit_test": "a01_hit_test",
    "quantile_hypotheses": "c04_quantile_thresholds",
    "threshold_grid": "c08_threshold_grid",
    "walk_forward": "b04_walk_forward",
    "row_blocks": "b02_row_blocks",
    "lag_independence": "t05_lag_independence",
    "permutation_test": "t07_permutation_test",
    "mode_combinations": "m02_mode_combinations",
    "scaled_logistic": "m05_logistic_scaled",
    "live_predictions": "r06_batch_predictions",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from workload.catalog import QUERIES

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("w07_rolling_std")  # starts the session's threads and compiles the first plans
    seconds = {label: round(run(name), 3) for label, name in HEADLINE.items()}
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "rows": rows,
        "rows_per_sec": {k: round(rows / v) for k, v in seconds.items()}, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
