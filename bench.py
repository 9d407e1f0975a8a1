"""Times every registered query and prints one JSON line.

Each query runs once to warm up and then ``BENCH_RUNS`` times (default 5); the median counts. The
result is written to Spark's no-op sink, so all columns are computed and nothing is collected.
The headline value is the sum over the headline queries.

Each of these derives the booking tables from the test data anew. ``warehouse`` holds the same queries on booking tables that were
published once before (``BENCH_WAREHOUSE_RUNS`` runs each, default 2; 0 leaves them out), and ``yardstick`` the seconds of a fixed computation, by which
runs on slower and faster machines can be compared.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from sojourn.plans import QUERIES  # noqa: E402
from sojourn.plans.registry import BUILDS  # noqa: E402
from sojourn.schemas import SCHEMAS  # noqa: E402
from sojourn.sources.testdata import load_testdata  # noqa: E402
from sojourn.sources.warehouse import load_set, publish_set  # noqa: E402

HEADLINE = [
    "revenue_trend", "revenue_trend_grain", "revenue_by_time", "revenue_by_tour", "revenue_comparison",
    "payment_methods", "top_tours_share", "top_customers", "kpi_full", "funnel", "customer_segments", "clv", "churn",
    "cohorts", "acquisition_first_value", "category_performance", "category_share", "tour_performance",
    "cancellation_analysis", "sales_velocity", "browse_tours", "similar_tours", "tour_document", "booking_enriched",
    "user_recent", "available_dates", "admit_bookings", "status_transition", "toggle_pairs", "dq_foreign_keys",
]


def median_seconds(run, runs: int) -> float:
    """Median of ``runs`` runs after one to warm up."""
    times = []
    for _ in range(runs + 1):
        started = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - started)
    return round(statistics.median(times[1:]), 4)


def published(spark: SparkSession, sf_dir: str):
    """The test data as booking tables that are read from a warehouse."""
    t = load_testdata(spark, sf_dir)
    root = tempfile.mkdtemp(prefix="sojourn-bench-")
    publish_set({name: getattr(t, name) for name in SCHEMAS if name in t}, root)
    stored = load_set(spark, root)
    return t.replace(**{name: getattr(stored, name) for name in stored.names()})


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    stored_runs = int(os.environ.get("BENCH_WAREHOUSE_RUNS", "2"))
    only = os.environ.get("BENCH_QUERIES")
    names = list(QUERIES) if only == "all" else only.split(",") if only else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sojourn-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    yardstick = median_seconds(lambda: spark.range(300_000_000).selectExpr("sum(id * 31 % 7) total"), 3)
    took = {name: median_seconds(lambda name=name: QUERIES[name](spark, sf_dir), runs) for name in names}
    again: dict[str, float] = {}
    if stored_runs:
        t = published(spark, sf_dir)
        again = {name: median_seconds(lambda name=name: BUILDS[name](t), stored_runs) for name in names}
    total = sum(took.values())
    print(
        json.dumps(
            {
                "metric": "sum of median seconds per query",
                "value": round(total, 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "runs": runs,
                "yardstick": yardstick,
                "warehouse": {"value": round(sum(again.values()), 3), "queries": again, "runs": stored_runs},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
