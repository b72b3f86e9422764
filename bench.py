"""Times the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all), BENCH_QUERIES (names, comma-separated).
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "assess_location", "create_master", "zero_fill_panel", "agg_location_week", "feature_pipeline", "additive_forecast",
    "compare_models", "forecast_horizon", "dedup_key", "clean_complaints", "clean_inspections", "exact_median_lines",
    "histogram_errors", "classification_report", "vector_search", "vector_search_location", "text_search", "chunk_text",
    "build_complaint_index", "context_string", "retrieval_summary", "scan_paged", "row_id", "sequences",
]


def main() -> None:
    from catalog import QUERIES
    from placewise.session import get_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = get_session("bench", os.environ.get("BENCH_CPUS", "*"), int(os.environ.get("BENCH_SHUFFLE", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    # one untimed query so that JVM and Python worker start-up is not charged to the first one
    QUERIES["group_sum"](spark, folder).write.format("noop").mode("overwrite").save()
    QUERIES["vector_search"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
