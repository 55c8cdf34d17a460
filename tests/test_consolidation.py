"""The consolidated frame against row-by-row matching, cached and uncached."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import enrich, match, skew
from tallyweave.plans import consolidation

CB, NOC = "Chargeback", "NotificationOfChargeback"


@pytest.fixture(scope="module")
def feeds_(spark):
    rng = random.Random(11)
    orders = ["7", "7-01", "8", " 9 ", "10-02", None] + ["7"] * 5
    disputes = [(f"d{i}", rng.choice(["A", "B", "C", None]), rng.choice([CB, NOC]), rng.choice(orders))
                for i in range(300)]
    ledger = [(1, "A", "1"), (2, "A", "2"), (3, "C", "3"), (4, None, "4")]
    reports = [("7", "p7", "open"), ("9", "p9", None), ("8", None, None)]
    documents = [("7-01", "s7-01"), ("7", "s7"), ("9-02", "s9-02"), ("10-01", "no"), ("10-02", "s10-02")]
    frames = (
        spark.createDataFrame(disputes, "dispute_id string, psp_reference string, record_type string, vtex_order_id string").repartition(5),
        spark.createDataFrame(ledger, "ordinal int, psp_reference_sap string, valor_sap string"),
        spark.createDataFrame(reports, "vtex_order_id string, cs_pedido string, cs_status_do_chargeback string"),
        spark.createDataFrame(documents, "order_id string, vtex_store string"),
    )
    charged = {d[1] for d in disputes if d[2] == CB}
    stores = {"7": "s7-01", "7-01": "s7-01", "9": "s9-02", "10-02": "s10-02"}
    expected = Counter()
    for d in disputes:
        order = d[3].strip() if d[3] else None
        report = {"7": "p7", "9": "p9"}.get(order)
        flag = "É Chargeback" if d[2] == CB else "Sim" if d[1] in charged and d[1] else "Não"
        source = "Adyen" + (" + SAP" if d[1] in ("A", "C") else "") + (" + ClearSale" if report else "")
        expected[(d[0], {"A": "1", "C": "3"}.get(d[1]), report, flag, source, stores.get(order))] += 1
    return frames, expected


OUT = ["dispute_id", "valor_sap", "cs_pedido", "virou_chargeback", "fonte", "vtex_store"]


def test_consolidate(feeds_):
    frames, expected = feeds_
    got = consolidation.consolidate(*frames)
    assert Counter(tuple(r) for r in got.select(OUT).collect()) == expected


def test_reports_and_documents_share_the_key_of_their_shuffle(feeds_, spark):
    frames, _ = feeds_
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = consolidation.consolidate(*frames)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = re.findall(r"SortMergeJoin (\[[^\]]*\], \[[^\]]*\])", plan)
    by_order = [j for j in joins if "_cell" in j and "_base" not in j]
    assert len(joins) == 4 and len(by_order) == 4
    assert not any("_report_order" in j for j in joins)


def test_disputes_without_an_order_go_past_its_shuffle(feeds_):
    frames, expected = feeds_
    profile = match.DisputeProfile(reference=skew.KeyProfile(("A",)), base_order=skew.KeyProfile(("7",), hot_null=True))
    got = consolidation.consolidate(*frames, profile=profile)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "concat(null " not in plan
    assert Counter(tuple(r) for r in got.select(OUT).collect()) == expected


def test_the_outer_match_is_not_run_for_a_profile(feeds_, monkeypatch):
    (disputes, ledger, reports, documents), _ = feeds_
    named = reports.withColumnsRenamed({"cs_pedido": "clearsale_pedido", "cs_status_do_chargeback": "clearsale_status"})

    def of_joined_rows(df, key):
        raise AssertionError(f"rows joined for a profile of {key}")

    monkeypatch.setattr(skew, "profile_key", of_joined_rows)
    outer = consolidation.outer_reconciliation(disputes, ledger, named)
    reported = {"7": "p7", "9": "p9"}
    rows = outer.select("vtex_order_id", "clearsale_pedido").collect()
    assert any(r[1] for r in rows) and all(r[1] == reported.get((r[0] or "").strip()) for r in rows)
    consolidation.outer_flow(disputes, ledger, named, documents)


def test_consolidate_cached(feeds_):
    (disputes, ledger, reports, documents), expected = feeds_
    ids = disputes.select(F.trim("vtex_order_id").alias("order_id")).where("order_id IS NOT NULL").distinct()
    cache = enrich.as_cache(enrich.resolve_candidates(ids, documents), F.current_timestamp())
    got = consolidation.consolidate_cached(disputes, ledger, reports, cache)
    assert Counter(tuple(r) for r in got.select(OUT).collect()) == expected


def test_few_rows_get_the_same_columns(feeds_, spark):
    (disputes, ledger, reports, _), expected = feeds_
    documents = spark.createDataFrame(
        [("7-01", '{"hostname":"s7-01"}'), ("7", '{"hostname":"s7"}'), ("9-02", '{"hostname":"s9-02"}'),
         ("10-02", '{"hostname":"s10-02"}')], "order_id string, detail string")
    got = consolidation.enrich_few(disputes.orderBy("dispute_id").limit(120), disputes, ledger, reports, documents)
    rows = {tuple(r) for r in got.select(OUT).collect()}
    assert len(rows) == 120 and rows <= set(expected)


def test_outer_extracts(feeds_):
    (disputes, ledger, reports, _), _ = feeds_
    named = reports.withColumnsRenamed({"cs_pedido": "clearsale_pedido", "cs_status_do_chargeback": "clearsale_status"})
    outer = consolidation.outer_reconciliation(disputes, ledger, named)
    assert outer.where("record_type = 'SAP Only'").count() == 1  # the posting without a reference
    n_a = disputes.where("psp_reference = 'A'").count()
    assert outer.where("psp_reference = 'A'").count() == 2 * n_a
    conversion = consolidation.conversion_extract(outer, ("dispute_id", "ordinal"))
    assert conversion.columns[:2] == ["virou_chargeback", "fonte"]
    both = consolidation.chargeback_extract(outer).count() + consolidation.notification_extract(outer).count()
    assert conversion.count() == both
    assert {r[0] for r in conversion.select("virou_chargeback").distinct().collect()} <= {"Sim", "Não"}


def test_older_flow_numbers_and_enriches(feeds_):
    (disputes, ledger, reports, documents), _ = feeds_
    named = reports.withColumnsRenamed({"cs_pedido": "clearsale_pedido", "cs_status_do_chargeback": "clearsale_status"})
    out = consolidation.outer_flow(disputes, ledger, named, documents)
    rows = out.collect()
    outer = consolidation.outer_reconciliation(disputes, ledger, named)
    assert Counter((r.dispute_id, r.ordinal, r.record_type) for r in rows) == Counter(
        (r.dispute_id, r.ordinal, r.record_type) for r in outer.collect())
    by_id = sorted(r.dispute_id for r in disputes.collect())
    assert all(by_id[r.adyen_id - 1] == r.dispute_id for r in rows if r.dispute_id)
    assert {(r.sap_id, r.ordinal) for r in rows if r.ordinal} <= {(i + 1, i + 1) for i in range(4)}
    stores = {"7": "s7-01", "7-01": "s7-01", "9": "s9-02", "10-02": "s10-02"}
    assert all(r.vtex_store == stores.get((r.vtex_order_id or "").strip()) for r in rows)
