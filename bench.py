"""Times the headline queries and prints one JSON line.

Each query is run once to warm up and then twice; the faster run counts.  The
result is written to the noop sink, so every row is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import catalogue  # noqa: E402
from tablewright.session import build_session  # noqa: E402

HEADLINE = (
    "parse_currency", "parse_percent", "parse_number", "detect_columns", "parse_dates_mixed", "date_evidence",
    "null_counts", "fill_median", "fill_mode", "fill_forward", "interpolate_linear",
    "dedupe_first", "dedupe_none", "dedupe_rows", "duplicate_provenance",
    "text_squeeze", "text_nfkc", "text_smart_title", "text_smart_title_documents",
    "join_chain", "join_orphans", "append_rows",
    "clean_orders", "clean_merged", "clean_joined", "totals", "csv_round_trip",
)
RUNS = 2


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in names:
        run(spark, name, sf_dir)
        seconds[name] = round(min(run(spark, name, sf_dir) for _ in range(RUNS)), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
