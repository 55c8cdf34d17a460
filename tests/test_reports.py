import json
import re
from contextlib import contextmanager
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyweave.operators import dash, metrics
from tallyweave.plans import consolidation
from tallyweave.sinks import exports

CB, NOC = "Chargeback", "NotificationOfChargeback"
SCHEMA = """dispute_id string, psp_reference string, record_type string, dispute_amount decimal(18,2),
 record_date timestamp_ntz, dispute_reason string, payment_method string, shopper_email string,
 vtex_order_id string, psp_reference_sap string, valor_sap string, cs_pedido string,
 cs_status_do_chargeback string, cs_item_principal string, cs_uf string, cs_cidade string,
 virou_chargeback string, fonte string, vtex_store string, vtex_cidade string, vtex_uf string,
 vtex_delivery_type string, vtex_categories string"""
FIELDS = re.findall(r"(\w+) (?:string|decimal|timestamp_ntz)", SCHEMA)


def row(**given):
    base = dict.fromkeys(FIELDS) | {"virou_chargeback": "Não", "fonte": "Adyen"}
    if "dispute_amount" in given and given["dispute_amount"] is not None:
        given["dispute_amount"] = Decimal(given["dispute_amount"])
    return tuple((base | given).values())


@pytest.fixture(scope="module")
def frame(spark):
    rows = [
        row(dispute_id="1", psp_reference="A", record_type=CB, dispute_amount="10.00", record_date=datetime(2024, 12, 31),
            dispute_reason="fraud", payment_method="visa", psp_reference_sap="A", valor_sap="9.5",
            cs_item_principal="i" * 70, cs_pedido="x", virou_chargeback="É Chargeback", vtex_uf="SC",
            vtex_delivery_type="Clique e Retire", vtex_categories="a | b", vtex_store="s1", shopper_email="e1"),
        row(dispute_id="2", psp_reference="A", record_type=NOC, dispute_amount="0.05", record_date=datetime(2025, 1, 1),
            payment_method="VISA", dispute_reason="fraud", virou_chargeback="Sim", cs_uf="PR", cs_pedido="y",
            vtex_delivery_type="Motoboy", vtex_categories="b", psp_reference_sap="A", valor_sap="n/d", shopper_email="e1"),
        row(dispute_id="3", psp_reference="B", record_type=NOC, record_date=datetime(2025, 1, 31, 23), payment_method="nan",
            dispute_reason="", vtex_uf="nan", vtex_cidade="X", cs_status_do_chargeback="", shopper_email="e2"),
        row(dispute_id="4", psp_reference="C", record_type=NOC, dispute_amount="1.00", payment_method="master"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def pairs(df):
    return [tuple(r) for r in df.collect()]


def test_kpis(frame):
    assert metrics.kpis(frame).first().asDict() == {
        "total_chargebacks": 1, "total_notifications": 3, "valor_total_cb": 10.0, "valor_total_noc": 1.05,
        "ticket_medio_cb": 10.0, "ticket_medio_noc": 0.53, "noc_que_viraram_cb": 1, "noc_total": 3,
        "taxa_conversao_noc_cb": 33.3, "com_sap": 2, "com_clearsale": 3,
    }
    d = dash.dash_kpis(frame).first()
    # no date drops row 4; the missing amount of row 3 counts as zero; no item is no report
    assert (d["total_notifications"], d["ticket_medio_noc"], d["com_clearsale"]) == (2, 0.025, 1)


def test_kpis_of_nothing_are_zero(frame):
    for empty in (metrics.kpis(frame.limit(0)), dash.dash_kpis(frame.limit(0))):
        assert set(empty.first()) == {0}
    assert set(metrics.cross_validation(frame.limit(0)).first()) == {0}


def test_monthly_counts_differ_on_missing_amounts(frame):
    assert pairs(metrics.monthly_evolution(frame)) == [("2024-12", 1, 10.0, 0, 0.0), ("2025-01", 0, 0.0, 1, 0.05)]
    assert pairs(dash.dash_monthly(frame)) == [("2024-12", 1, 10.0, 0, 0.0), ("2025-01", 0, 0.0, 2, 0.05)]
    assert pairs(dash.dash_monthly(frame, "2025-01")) == [("2025-01", 0, 0.0, 2, 0.05)]
    assert pairs(metrics.ledger_monthly(frame)) == [("2024-12", 1, 9.5), ("2025-01", 0, 0.0)]


def test_locations(frame):
    assert pairs(metrics.by_state(frame)) == [("PR", 1, 0.05), ("SC", 1, 10.0), ("nan", 0, 0.0)]
    assert pairs(dash.dash_state(frame)) == [("SC", 1, 10.0)]
    assert pairs(dash.dash_city(frame)) == [("X", 1)]


def test_methods_and_reasons(frame):
    assert pairs(metrics.by_payment_method(frame)) == [("VISA", 1), ("master", 1), ("nan", 1), ("visa", 1)]
    assert pairs(dash.dash_method(frame)) == [("VISA", 2)]
    assert pairs(metrics.by_reason(frame, 1)) == [("fraud", 2)]
    assert pairs(metrics.by_reason(frame)) == [("fraud", 2), ("", 1)]
    assert pairs(dash.dash_reason(frame)) == [("fraud", 2)]


def test_delivery_and_categories(frame):
    assert pairs(metrics.by_delivery(frame)) == [("Clique e Retire", 1), ("Motoboy", 1)]
    assert pairs(dash.dash_delivery(frame)) == [("Outros", 2)]
    assert pairs(metrics.by_category(frame)) == [("b", 2), ("a", 1)]
    assert pairs(dash.dash_category(frame, "2025-01")) == [("b", 1)]


def test_items_are_cut_or_not(frame):
    assert pairs(metrics.by_item(frame)) == [("i" * 60, 1)]
    assert pairs(dash.dash_item(frame)) == [("i" * 70, 1)]


def test_cross_validation_adds_up(frame):
    for report in (metrics.cross_validation(frame), dash.dash_cross_validation(frame)):
        r = report.first()
        assert r["encontrados_no_sap"] + r["nao_encontrados_sap"] == r["total_adyen_cb_noc"]
        assert r["encontrados_no_clearsale"] + r["nao_encontrados_clearsale"] == r["total_adyen_cb_noc"]
    assert dash.dash_cross_validation(frame).first()["encontrados_no_clearsale"] == 2


def test_open_range_equals_whole_table(frame):
    dated = frame.where("record_date IS NOT NULL")
    for report in (dash.dash_kpis, dash.dash_monthly, dash.dash_state, dash.dash_method, dash.dash_top_records):
        assert pairs(report(frame)) == pairs(report(dated, "2024-12", "2025-01"))


def test_monthly_totals_equal_kpis(frame):
    k = metrics.kpis(frame.where("record_date IS NOT NULL")).first()
    m = metrics.monthly_evolution(frame).agg(F.sum("cb_total"), F.sum("noc_total")).first()
    assert tuple(m) == (k["valor_total_cb"], k["valor_total_noc"])


def test_top_records(frame):
    assert [r["dispute_id"] for r in metrics.top_records(frame, k=2).collect()] == ["1", "4"]
    assert [r["dispute_id"] for r in dash.dash_top_records(frame, k=3).collect()] == ["1", "2", "3"]


def test_tiers_and_shares(frame):
    emails = metrics.top_emails(frame)
    assert pairs(metrics.recurrence_tier(emails, 2)) == [("e1", 2, "danger"), ("e2", 1, "warning")]
    assert [r["pct"] for r in metrics.share_of_total(emails).collect()] == [66.7, 33.3]


def test_raw_export(frame, tmp_path):
    rows = {r["Psp Reference"] + r["type"][0]: r.asDict() for r in exports.raw_export(frame).collect()}
    assert rows["AC"]["sap"] is True and rows["BN"]["sap"] is False
    assert rows["AC"]["amount"] == 10.0 and rows["AC"]["date"] == "2024-12-31" and rows["CN"]["date"] is None
    exports.write_raw_export(frame, str(tmp_path / "raw"))
    text = "".join(p.read_text() for p in (tmp_path / "raw").glob("*.json"))
    assert '"date":null' in text and len(text.splitlines()) == 4


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_consolidated_extracts(spark, frame, tmp_path, fmt):
    rows = frame.where(F.col("record_type") == NOC).withColumn("virou_chargeback", F.lit("Não"))
    written = exports.consolidated_extracts(rows, str(tmp_path / "out"), fmt)
    assert set(written) == {"Consolidado", "Notifications", "Resumo_Mensal"}
    back = spark.read.format(fmt).option("header", "true").load(written["Notifications"])
    assert back.count() == 3
    assert set(exports.consolidated_extracts(frame, str(tmp_path / "all"), fmt)) == set(exports.EXTRACTS)


def test_copies_of_a_row_are_written_as_they_come(spark, frame, tmp_path, monkeypatch):
    name, seen = "spark.sql.maxConcurrentOutputFileWriters", []
    before, given = spark.conf.get(name, None), exports.settings

    @contextmanager
    def noted(*args, **conf):
        with given(*args, **conf):
            seen.append(spark.conf.get(name))
            yield

    monkeypatch.setattr(exports, "settings", noted)
    written = exports.consolidated_extracts(frame, str(tmp_path / "out"))
    assert seen == [str(len(exports.EXTRACTS))] and spark.conf.get(name, None) == before
    for extract in set(written) - {"Resumo_Mensal"}:
        for part in Path(written[extract]).glob("*.parquet"):
            assert pq.ParquetFile(part).metadata.row_group(0).column(0).compression == "ZSTD"


def test_dashboard_document_agrees_with_reports(frame):
    rows = consolidation.dashboard_document(frame, generated="2025-06-01 00:00:00").collect()
    doc = {r["section"]: json.loads(r["json"]) for r in rows}
    assert len(doc) == len(rows)
    assert doc["meta"] == {"periodo": "Dez/24 — Jan/25", "gerado_em": "2025-06-01 00:00:00"}
    assert doc["kpis"]["total_notifications"] == 3
    monthly = doc["evolucao_mensal"]
    assert monthly["labels"] == ["2024-12", "2025-01"]
    report = metrics.monthly_evolution(frame).collect()
    assert monthly["chargeback"] == {"count": [r.cb_count for r in report], "total": [r.cb_total for r in report]}
    assert monthly["notification"] == {"count": [r.noc_count for r in report], "total": [r.noc_total for r in report]}
    postings = metrics.ledger_monthly(frame).collect()
    assert doc["sap_mensal"] == {"labels": [r.month for r in postings], "count": [r.n for r in postings],
                                 "total": [r.total for r in postings]}
    assert doc["top_registros"][0]["dispute_id"] == "1"
    expected = {
        "por_ferramenta": metrics.by_source, "por_motivo": metrics.by_reason,
        "por_bandeira": metrics.by_payment_method, "por_entrega": metrics.by_delivery,
        "por_categoria_vtex": metrics.by_category, "por_produto_cs": metrics.by_item,
        "por_loja": metrics.by_store, "top_emails": metrics.top_emails,
        "virou_chargeback": metrics.by_conversion, "record_types": metrics.by_record_type,
    }
    for section, report in expected.items():
        rows = report(frame).collect()
        assert doc[section] == {"labels": [r["label"] for r in rows], "values": [r["n"] for r in rows]}, section
    states = metrics.by_state(frame).collect()
    assert doc["por_uf"]["labels"] == [r["label"] for r in states]
    assert doc["por_uf"]["count"] == [r["n"] for r in states]


def test_dashboard_document_takes_long_sections(spark, frame):
    many = spark.range(20_000).select(F.concat(F.lit("m"), "id").alias("payment_method"))
    long = frame.drop("payment_method").limit(1).crossJoin(many)
    doc = {r["section"]: json.loads(r["json"]) for r in consolidation.dashboard_document(long).collect()}
    assert len(doc["por_bandeira"]["labels"]) == len(set(doc["por_bandeira"]["labels"])) == 20_000


def test_preview_and_profile(frame):
    assert exports.preview(frame, 2).count() == 2
    profile = {r["column"]: r for r in exports.profile_columns(frame, 2).collect()}
    assert list(profile) == frame.columns
    assert profile["dispute_amount"]["type"] == "decimal(18,2)" and len(profile["dispute_id"]["sample"]) == 2
