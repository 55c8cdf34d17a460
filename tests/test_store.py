"""Reports served from the frame stored by month."""

import re
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pyspark.sql.types import StructType

from tallyweave.catalog import fixtures
from tallyweave.operators import dash, feeds, metrics
from tallyweave.plans import consolidation, store
from tallyweave.sinks import exports

from .test_reports import SCHEMA, row

SF = "/root/testdata/sf0.001"
REPORTS = ("kpis", "monthly_evolution", "ledger_monthly", "by_state", "by_city", "by_item", "by_delivery_detail", "by_category",
           "by_store", "by_source", "cross_validation", "top_emails", "top_records", "dash_kpis", "dash_status", "dash_city",
           "dash_delivery", "dash_cross_validation", "dash_top_records", "raw_export", "dashboard_sections")
CB, NOC = "Chargeback", "NotificationOfChargeback"


@pytest.fixture(scope="module")
def rows(spark):
    made = [row(dispute_id=str(i), psp_reference="A", record_type=CB if i % 3 else NOC, dispute_amount=f"{i}.50",
                record_date=None if i % 11 == 0 else datetime(2024 + i % 2, 1 + i % 12, 1 + i % 28, i % 24),
                dispute_reason=f"r{i % 5}", vtex_uf=f"u{i % 4}") for i in range(300)]
    return spark.createDataFrame(made, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def stored(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "rows")
    return store.open_store(spark, path, store.write_store(rows, path))


def _content(df):
    return Counter(tuple(r) for r in df.collect())


def test_every_row_is_stored_once(rows, stored):
    assert _content(stored.drop(feeds.STORED_MONTH)) == _content(rows)
    months = {r[0] for r in stored.select(feeds.STORED_MONTH).distinct().collect()}
    assert None in months and months - {None} == {f"{2024 + i % 2}-{1 + i % 12:02}" for i in range(300) if i % 11}


@pytest.mark.parametrize("start,end", [(None, None), ("2024-05", None), (None, "2024-12"), ("2024-11", "2025-02"), ("2030-01", "2030-02")])
def test_reports_of_a_period_are_those_of_the_rows(rows, stored, start, end):
    for report in (dash.dash_kpis, dash.dash_monthly, dash.dash_reason, dash.dash_state, dash.dash_top_records):
        assert report(stored, start, end).collect() == report(rows, start, end).collect()


def test_a_period_reads_its_months_only(stored):
    plan = dash.dash_kpis(stored, "2024-11", "2025-02")
    list(plan.collect())
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(stored_month" in text
    kept = feeds.month_range_filter(stored, "2024-11", "2025-02")
    read = kept.select(F.input_file_name().alias("f")).distinct().collect()
    folders = {r.f.split("stored_month=")[1].split("/")[0] for r in read}
    assert folders <= {"2024-11", "2024-12", "2025-01", "2025-02"} and folders
    # the scan itself, not a filter above it, leaves the other months out
    scan = next(x for x in text.split("\n") if "FileScan parquet" in x)
    assert "stored_month" in scan.split("PartitionFilters")[1]


def test_the_frame_is_not_shuffled_by_month(spark, rows, tmp_path):
    def files(path, **how):
        kept = store.open_store(spark, path, store.write_store(rows, path, **how))
        names = kept.select(F.input_file_name()).distinct().collect()
        return Counter(n.split("stored_month=")[1].split("/")[0] for (n,) in names)

    own, gathered = files(str(tmp_path / "own")), files(str(tmp_path / "gathered"), gather=True)
    assert max(own.values()) == 4  # tasks of the frame
    assert set(gathered.values()) == {1} and set(own) == set(gathered)


def test_rows_without_a_date_count_in_whole_reports(rows, stored):
    assert metrics.kpis(stored).collect() == metrics.kpis(rows).collect()
    assert metrics.by_state(stored).collect() == metrics.by_state(rows).collect()


def test_the_store_holds_what_reports_read_and_no_more(spark, tmp_path):
    whole = fixtures.consolidated(spark, SF, *fixtures.REPORT_ATTRIBUTES).schema
    path = str(tmp_path / "whole")
    spark.createDataFrame([], StructType([*whole.fields]).add(feeds.STORED_MONTH, "string")).write.parquet(path)
    frame, asked = spark.read.parquet(path), set()
    spark.conf.set("spark.sql.maxMetadataStringLength", 100_000)
    for module in (metrics, dash, exports, consolidation):
        for report in (getattr(module, n) for n in REPORTS if hasattr(module, n)):
            plan = report(frame)._jdf.queryExecution().executedPlan().toString()
            asked |= {f.split(":")[0] for read in re.findall(r"ReadSchema: struct<([^>]*)>", plan) for f in read.split(",")}
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert len(asked & set(whole.names)) > 15
    assert asked & set(whole.names) <= set(fixtures.SERVED) < set(whole.names)
    assert "metadata" not in fixtures.SERVED
