"""Times the headline queries: ``BENCH_SF_DIR``, ``BENCH_CPUS`` and ``BENCH_REPEATS`` choose
the data, the threads and the runs per query. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from checks.compare import session
from checks.queries import QUERIES

HEADLINE = (
    "profile_table", "numeric_stats", "quartiles", "value_counts_top5", "dedupe_rows", "impute_median", "impute_mode",
    "unit_standardise", "datetime_coerce", "type_ladder_counts", "outlier_remove_any", "outlier_summary", "semantic_types",
    "missing_profile", "distinct_exact", "histogram_counts", "validate_range", "clean_run", "clean_run_spec",
    "csv_roundtrip",
)


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    times, failed = {}, {}
    for name in sys.argv[1:] or HEADLINE:
        try:
            run(spark, name, sf_dir)  # warm-up
            times[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(repeats)), 3)
        except Exception as e:  # the others still count
            failed[name] = f"{type(e).__name__}: {e}"[:300]
    spark.stop()
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf, **({"failed": failed} if failed else {})}))
    if failed:
        sys.exit(1)


if __name__ == "__main__":
    main()
