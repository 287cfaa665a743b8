"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores. Each query runs once untimed, then three times; the median of
the three counts. Every result row is produced in full (no-op sink).
"""

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from slowtide.plans.registry import QUERIES  # noqa: E402
from slowtide.session import build_session, drop_intermediate  # noqa: E402

HEADLINE = {
    "practice_log_counts": "messages per thread author",
    "document_sentences": "sentence split",
    "tumbling_windows": "daily windows",
    "sliding_windows": "weekly windows, daily step",
    "time_scale_grids": "30 window lengths at once",
    "pooled_vectors": "mean vectors in overlapping windows",
    "vector_covariance": "covariance matrices, 64 dimensions",
    "memoised_scores": "label scores through the score table, three runs",
    "slow_features": "slow features per author, 384 dimensions",
    "slowness_over_time_scales": "slowness for 30 window lengths, 384 dimensions",
    "slowness_gain_of_all_labels": "label gains, 69 labels, 1000 orders",
    "window_texts": "texts of weekly windows",
    "amplitude_spectra": "spectra of hourly means",
    "typical_sentences": "extreme sentences per author",
    "slowness_analysis_deltas": "slowness analysis, 69 labels",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "slowtide-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="slowtide-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total of medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    drop_intermediate(spark)
    spark.stop()


if __name__ == "__main__":
    main()
