"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from shopcat.plans.queries import QUERIES  # noqa: E402
from shopcat.session import configure  # noqa: E402

HEADLINE = (
    "page_title", "page_main_text", "isbn_scan", "shop_books", "shop_offers", "strategies",
    "shop_overview", "page_types", "price_vectors", "selector_modes", "merged_books",
    "catalog_upsert", "best_offer", "offer_history", "distinct_offers", "frontier_latest",
    "job_counters", "job_batches", "job_triage", "stream_page_types", "stream_best_offer",
    "catalog_roundtrip", "stream_catalog",
)


def run(spark: SparkSession, name: str, sf: str) -> tuple[float, float]:
    """(seconds in all, seconds of them to build the query, with the jobs it runs for that)."""
    start = time.perf_counter()
    df = QUERIES[name](spark, sf)
    built = time.perf_counter() - start
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start, built


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        configure(SparkSession.builder.master(f"local[{cpus}]").appName("shopcat-bench"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "page_site", sf)  # starts the session's services
    # The first run of a query pays for code generation; the second is its throughput.
    best = {name: min(run(spark, name, sf) for _ in range(2)) for name in names}
    times = {name: round(t, 3) for name, (t, _) in best.items()}
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "build": {name: round(b, 3) for name, (_, b) in best.items()}, "sf": Path(sf).name,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
