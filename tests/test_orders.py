import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import enrich
from tallyweave.operators import windows


@pytest.fixture
def flat(spark):
    def run(doc):
        df = spark.createDataFrame([("o", json.dumps(doc) if not isinstance(doc, str) else doc)],
                                   "order_id string, detail string")
        return enrich.flatten_detail(df).first().asDict()

    return run


FULL = {
    "hostname": "h", "sellers": [{"name": "CENTRO 1 - 88 - 1"}, {"name": "B"}],
    "shippingData": {"address": {"state": "SC", "city": "Itajaí", "postalCode": "89", "addressType": "residential"},
                     "logisticsInfo": [{"selectedSla": "Normal", "shippingEstimate": "3bd"}, {"selectedSla": "x"}]},
    "packageAttachment": {"packages": [{"invoiceKey": "K", "invoiceNumber": "7"}]},
    "paymentData": {"transactions": [{"payments": [{"installments": 3, "value": 1000}]}]},
    "marketingData": {"coupon": "", "couponCode": "C1"},
    "totals": [{"id": "Items", "value": 9}, {"id": "Discounts", "value": -500}, {"id": "Discounts", "value": -9}],
    "items": [{"name": "n1", "productCategories": {"1": "Z", "2": "A"}},
              {"name": "", "productCategories": {"1": "A", "3": None, "4": ""}}, {"name": "n2"}],
}


def test_full_document(flat):
    assert flat(FULL) == {
        "order_id": "o", "uf": "SC", "cidade": "Itajaí", "cep": "89", "address_type": "residential",
        "sla_type": "Normal", "delivery_deadline": "3bd", "invoice_key": "K", "invoice_number": "7",
        "vtex_store": "CENTRO 1", "vtex_installments": 3, "vtex_installment_value": 3.33,
        "vtex_coupon": "C1", "vtex_discount_value": 5.0, "vtex_products": "n1 | n2",
        "vtex_categories": "A | Z",
    }


@pytest.mark.parametrize("doc", [{}, "{bad", "[]", {"sellers": [], "items": [], "totals": [],
                                                    "paymentData": {"transactions": []}}])
def test_empty_documents_give_nulls(flat, doc):
    out = flat(doc)
    assert out.pop("order_id") == "o" and set(out.values()) == {None}


@pytest.mark.parametrize("sellers, store", [
    ([], "h"), ([{"name": ""}], "h"), ([{"name": " - 88"}], "h"), ([{}], "h"), ([{"name": "A-B"}], "A-B"),
])
def test_store_falls_back_to_host(flat, sellers, store):
    assert flat({"hostname": "h", "sellers": sellers})["vtex_store"] == store


@pytest.mark.parametrize("count, value, each", [(0, 1000, None), (None, 1000, None), (7, 1000, 1.43), (2, None, None)])
def test_instalments(flat, count, value, each):
    doc = {"paymentData": {"transactions": [{"payments": [{"installments": count, "value": value}]}]}}
    assert flat(doc)["vtex_installment_value"] == each


@pytest.mark.parametrize("value, amount", [(0, None), (250, 2.5), (-1, 0.01)])
def test_discount(flat, value, amount):
    assert flat({"totals": [{"id": "Discounts", "value": value}]})["vtex_discount_value"] == amount


def test_delivery_type_loses_closing_bracket(spark):
    flat = spark.createDataFrame(
        [("1", "Normal", "residential"), ("2", None, None), ("3", "", "pickup"), ("4", "SLA", None)],
        "order_id string, sla_type string, address_type string")
    from tallyweave.functions.nested import delivery_type
    got = [r[0] for r in flat.orderBy("order_id").select(
        delivery_type(F.col("sla_type"), F.col("address_type"))).collect()]
    assert got == ["Normal (residential", "", "pickup", "SLA"]


def test_collapse_takes_first_values_in_load_order(spark):
    rows = [("1", 3, "c", None, "z"), ("1", 1, None, None, "x"), ("1", 2, "b", "u", "y"), (None, 4, "n", "n", "n")]
    df = spark.createDataFrame(rows, "order_id string, at int, sla_type string, uf string, note string")
    got = [tuple(r) for r in enrich.collapse_orders(df, ["at"]).collect()]
    assert got == [("1", "b", "u")]


def test_window_plan_covers_whole_days(spark):
    days = spark.sql("SELECT DATE'2026-04-20' AS first_day, DATE'2026-04-21' AS last_day")
    plan = windows.window_plan(days).orderBy("window_start").collect()
    assert len(plan) == 24
    assert plan[0]["window_start"] == datetime(2026, 4, 20) and plan[-1]["window_end"] == datetime(2026, 4, 22)
    assert all(a["window_end"] == b["window_start"] for a, b in zip(plan, plan[1:]))
    uneven = windows.window_plan(days, hours=7).orderBy("window_start").collect()
    assert uneven[-1]["window_end"] == datetime(2026, 4, 22)


def test_capped_extract_and_volume(spark):
    rows = [(i, datetime(2026, 4, 20, i // 40, i % 40)) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, ts timestamp_ntz").repartition(5)
    volume = {r["window_start"].hour: (r["n_rows"], r["over_cap"])
              for r in windows.window_volume(df, "ts", cap=50).collect()}
    assert volume == {0: (80, True), 2: (40, False)}
    kept = sorted(r["i"] for r in windows.capped_extract(df, "ts", ["i"], cap=50).collect())
    assert kept == list(range(50)) + list(range(80, 120))
