"""The registered queries by group; each takes ``(spark, sf_dir)``."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyweave import constants as C
from tallyweave.catalog import fixtures as fx
from tallyweave.catalog.oracles import DASH_END, DASH_START, REPORT_TIME
from tallyweave.functions import dates, nested, numbers, text
from tallyweave.operators import dash, enrich, feeds, ids, match, metrics, windows
from tallyweave.plans import consolidation
from tallyweave.session import cut_lineage, shared_dir
from tallyweave.sinks import cache as order_cache, exports
from tallyweave.sources import delimited, documents, feeds as file_feeds, listing, orders

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ROW_ID = ("dispute_id",)
EVENT_CAP = 35  # windows of the events table are small; this cap makes some overflow


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder on the shared storage, for queries that write and read back."""
    return f"{shared_dir(spark)}/tallyweave/{name}-{uuid.uuid4().hex}"


# --- scans and normalisation -------------------------------------------------

@query
def union_by_name(spark, sf):
    placed = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("placed"),
        F.col("o_custkey").alias("customer"))
    customers = fx.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    return feeds.union_by_name([placed, customers])


@query
def sample_scan(spark, sf):
    return listing.sample_scan(fx.raw_disputes(spark, sf), C.SAMPLE_ROWS, ROW_ID)


@query
def filter_record_types(spark, sf):
    kept = feeds.filter_record_types(fx.raw_disputes(spark, sf))
    return kept.select("dispute_id", "record_type", "dispute_amount")


@query
def extract_order_id(spark, sf):
    return feeds.extract_order_id(fx.raw_disputes(spark, sf)).select("dispute_id", "vtex_order_id")


@query
def normalize_mixed_dates(spark, sf):
    """Order dates as text, by file in one of two conventions, some unreadable."""
    key = F.col("o_orderkey")
    day_first = key % 5 < 2
    paid = F.col("o_orderdate") + F.expr("INTERVAL '13:05' HOUR TO MINUTE")
    rows = fx.table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("file"), (key % 5).cast("string")).alias("source_file"),
        F.when(key % 97 == 0, "soon")
        .when(day_first, F.date_format("o_orderdate", "dd/MM/yyyy"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("record_date"),
        F.when(key % 89 == 0, "")
        .when(day_first & (key % 10 < 5), F.date_format(paid, "d/M/yyyy HH:mm"))
        .otherwise(F.date_format(paid, "yyyy-MM-dd HH:mm:ss")).alias("payment_date"),
    )
    out = feeds.normalize_mixed_dates(rows, ["record_date", "payment_date"], "source_file",
                                      ["o_orderkey"])
    return out.drop("source_file")


@query
def filter_narrative(spark, sf):
    kept = feeds.filter_narrative(fx.raw_ledger(spark, sf), "denominacao_sap")
    return kept.select("ordinal", "denominacao_sap")


@query
def extract_psp(spark, sf):
    return fx.ledger(spark, sf).select("ordinal", "denominacao_sap", "psp_reference_sap")


@query
def extract_nsu(spark, sf):
    return fx.ledger(spark, sf).select("ordinal", "denominacao_sap", "nsu")


@query
def order_key_prefix(spark, sf):
    return fx.raw_antifraud(spark, sf).select(
        "ordinal", F.col("PEDIDO").alias("pedido"), text.order_key_prefix("PEDIDO").alias("vtex_order_id"))


@query
def prefix_columns(spark, sf):
    return feeds.prefix_columns(fx.raw_antifraud(spark, sf), "cs_", keep=("ordinal",))


@query
def dense_ids(spark, sf):
    rows = fx.ledger(spark, sf).select("ordinal", "psp_reference_sap")
    return ids.dense_ids(rows, ["ordinal"], "sap_id")


@query
def dense_ids_disputes(spark, sf):
    return ids.dense_ids(fx.disputes(spark, sf).select("dispute_id"), ["dispute_id"], "adyen_id")


@query
def rename_select(spark, sf):
    names = {"dispute_id": "dispute_id", "psp_reference": "Psp Reference", "record_type": "type",
             "dispute_amount": "amount", "record_date": "date", "vtex_order_id": "vtex_order_id",
             "not_there": "x"}
    return feeds.rename_select(fx.disputes(spark, sf), names)


@query
def try_numeric(spark, sf):
    return feeds.try_numeric(fx.ledger(spark, sf).select("ordinal", "valor_sap"), "valor_sap")


@query
def parse_utc(spark, sf):
    key, ts = F.col("event_id"), F.col("ts")
    rows = fx.table(spark, sf, "events").select(
        key,
        F.when(key % 31 != 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .otherwise("unknown").alias("creation_date"),
        F.when(key % 37 != 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
        .alias("last_change"),
        F.lit("n/a").alias("authorized_date"),
    )
    return feeds.parse_utc(rows, ["creation_date", "last_change", "authorized_date", "absent"])


@query
def cents_to_amount(spark, sf):
    cents = (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint")
    rows = fx.table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 29 != 0, cents).alias("cents"))
    return rows.select("o_orderkey", numbers.cents_to_amount("cents").alias("total_value"))


@query
def valid_order_ids(spark, sf):
    return feeds.valid_order_ids(fx.disputes(spark, sf))


def _delivery_texts(spark, sf):
    flat = enrich.flatten_part(fx.order_details(spark, sf), *nested.logistics(F.col("doc")),
                               *nested.address(F.col("doc")))
    shown = nested.delivery_type(F.col("sla_type"), F.col("address_type"))
    return flat.select("order_id", shown.alias("vtex_delivery_type"))


@query
def classify_delivery(spark, sf):
    return _delivery_texts(spark, sf).withColumn(
        "delivery", text.classify_delivery("vtex_delivery_type"))


@query
def classify_delivery_dash(spark, sf):
    return _delivery_texts(spark, sf).withColumn(
        "delivery", text.classify_delivery_dash("vtex_delivery_type"))


@query
def truncate_label(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", text.truncate_label("text").alias("label"))


@query
def month_range_filter(spark, sf):
    kept = feeds.month_range_filter(fx.disputes(spark, sf), DASH_START, DASH_END)
    return kept.select("dispute_id", "record_date", "dispute_amount")


@query
def coalesce_location(spark, sf):
    return enrich.coalesce_location(fx.located(spark, sf)).select(
        "dispute_id", "uf_combined", "cidade_combined")


@query
def upper_method(spark, sf):
    return fx.disputes(spark, sf, "payment_method").select(
        "dispute_id", text.upper_method("payment_method").alias("pm"))


@query
def month_label(spark, sf):
    months = fx.disputes(spark, sf).select(dates.month_key("record_date").alias("month")).distinct()
    return months.withColumn("label", dates.month_label("month"))


@query
def move_to_front(spark, sf):
    rows = fx.with_flag(spark, sf).select("dispute_id", "psp_reference", "record_type", "virou_chargeback")
    return feeds.move_to_front(rows, ["virou_chargeback", "record_type"])


# --- matching ----------------------------------------------------------------

@query
def dedup_first(spark, sf):
    rows = fx.ledger(spark, sf).select("ordinal", "psp_reference_sap", "denominacao_sap", "valor_sap")
    return match.dedup_first(rows, "psp_reference_sap", "ordinal")


@query
def dedup_last(spark, sf):
    return fx.antifraud(spark, sf).select(
        "vtex_order_id", "cs_pedido", "cs_status_do_chargeback", "cs_score")


@query
def dedup_by_key(spark, sf):
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = fx.table(spark, sf, "lineitem").select("l_orderkey", *order)
    return match.dedup_by_key(rows, "l_orderkey", order).drop("l_extendedprice")


@query
def match_ledger(spark, sf):
    return fx.with_ledger(spark, sf).select(
        "dispute_id", "psp_reference", "psp_reference_sap", "denominacao_sap",
        "data_lancamento_sap", "valor_sap")


def _outer(spark, sf):
    return match.match_ledger_outer(
        fx.disputes(spark, sf).select("dispute_id", "psp_reference", "record_type",
                                      "dispute_amount", "vtex_order_id"),
        fx.ledger(spark, sf).select("ordinal", "psp_reference_sap", "nsu", "valor_sap"),
    )


@query
def match_ledger_outer(spark, sf):
    return _outer(spark, sf)


@query
def match_antifraud(spark, sf):
    return fx.with_antifraud(spark, sf).select(
        "dispute_id", "vtex_order_id", "cs_pedido", "cs_status_do_chargeback", "cs_uf",
        "cs_cidade", "cs_item_principal", "cs_score")


@query
def flag_noc_conversion(spark, sf):
    return fx.with_flag(spark, sf).select("dispute_id", "record_type", "virou_chargeback")


@query
def flag_noc_conversion_v2(spark, sf):
    return match.flag_noc_conversion_v2(fx.disputes(spark, sf)).select(
        "dispute_id", "record_type", "virou_chargeback")


@query
def label_provenance(spark, sf):
    return fx.reconciled(spark, sf).select("dispute_id", "fonte")


@query
def match_rates(spark, sf):
    return match.match_rates(fx.reconciled(spark, sf))


def _stored_answers(spark, sf):
    """A cache that answers every third disputed order, and others that no dispute names.

    Some of the answers are failed lookups.
    """
    wanted = feeds.valid_order_ids(fx.disputes(spark, sf))
    number = F.col("order_id").cast("bigint")
    status = F.when(number % 9 == 0, "error").when(number % 2 == 0, "not_found").otherwise("found")
    asked = F.when(number % 3 == 0, F.col("order_id")).otherwise(F.concat(F.lit("N"), "order_id"))
    return wanted.withColumn("status", status).withColumn("order_id", asked)


@query
def missing_orders(spark, sf):
    wanted = feeds.valid_order_ids(fx.disputes(spark, sf))
    return enrich.missing_orders(wanted, _stored_answers(spark, sf))


@query
def resolve_candidates(spark, sf):
    key = F.col("o_orderkey")
    wanted = fx.table(spark, sf, "orders").select(
        F.concat(key.cast("string"), F.when(key % 10 == 2, "-02").otherwise("")).alias("order_id"))
    doc = F.col("doc")
    flat = enrich.flatten_part(fx.order_details(spark, sf), doc["hostname"].alias("hostname"),
                               doc["shippingData"]["address"]["city"].alias("city"))
    return enrich.resolve_candidates(wanted, flat)


def _cache_answers(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Old and new answers; a sixth of the orders has both, some of these with an older new one."""
    key = F.col("o_orderkey")
    listed = fx.table(spark, sf, "orders")
    placed = F.col("o_orderdate")

    def answers(prefix, status, at, other):
        return [F.concat(other, key.cast("string")).alias("order_id"),
                F.concat(F.lit(prefix), F.col("o_orderstatus")).alias("vtex_store"),
                F.lit(status).alias("status"), at.alias("fetched_at")]

    cache = listed.select(*answers("old ", "found", placed, F.when(key % 2 == 0, "").otherwise("A")))
    late = F.when(key % 5 == 0, placed - F.expr("INTERVAL 1 DAY")).otherwise(placed)
    return cache, listed.select(*answers("new ", "not_found", late, F.when(key % 3 == 0, "").otherwise("B")))


@query
def upsert_cache(spark, sf):
    return enrich.upsert_cache(*_cache_answers(spark, sf)).drop("fetched_at")


@query
def update_cache(spark, sf):
    """The same answers merged into a stored cache, whose touched buckets are rewritten."""
    old, fresh = _cache_answers(spark, sf)
    path = fresh_path(spark, "cache-buckets")
    for answers in (old, fresh):
        order_cache.update_cache(path, answers)
    return order_cache.read_cache(spark, path, old.schema).drop("fetched_at", order_cache.BUCKET)


@query
def attach_enrichment(spark, sf):
    """Attributes resolved per distinct order, kept as a cache, then joined to the disputes."""
    rows = fx.disputes(spark, sf)
    attributes = fx.order_attributes(spark, sf)
    cache = enrich.resolve_candidates(feeds.valid_order_ids(rows), attributes)
    return enrich.attach_enrichment(rows, cache, ROW_ID).select(
        "dispute_id", "vtex_order_id", *C.ENRICHMENT_COLUMNS)


@query
def attach_documents(spark, sf):
    """The same attributes, joined straight from the order documents."""
    return fx.with_orders(spark, sf).select("dispute_id", "vtex_order_id", *C.ENRICHMENT_COLUMNS)


@query
def record_type_set(spark, sf):
    return match.record_type_set(fx.raw_disputes(spark, sf))


@query
def reconcile(spark, sf):
    return fx.reconciled(spark, sf).select(
        "dispute_id", "psp_reference", "record_type", "dispute_amount", "record_date",
        "vtex_order_id", "psp_reference_sap", "data_lancamento_sap", "valor_sap", "cs_pedido",
        "cs_status_do_chargeback", "cs_item_principal", "virou_chargeback", "fonte")


# --- order documents ---------------------------------------------------------

@query
def flatten_order(spark, sf):
    return enrich.flatten_order(fx.order_list(spark, sf))


@query
def scan_orders_json(spark, sf):
    """Listed orders written as JSON lines and scanned back with a declared schema."""
    path = fresh_path(spark, "orders-json")
    fx.order_list(spark, sf).write.text(path)
    return orders.scan_orders_json(spark, path).select(
        "order_id", "sequence", "client_name", "total_value", "creation_date", "last_change",
        "authorized_date")


def _detail_part(name: str, parts: Callable) -> None:
    def run(spark, sf):
        columns = parts(F.col("doc"))
        return enrich.flatten_part(
            fx.order_details(spark, sf), *(columns if isinstance(columns, list) else [columns]))

    REGISTRY[name] = run


for _name, _parts in {
    "order_address": nested.address, "order_logistics": nested.logistics,
    "order_invoice": nested.invoice, "order_store": nested.store,
    "order_installments": nested.installments, "order_coupon": nested.coupon,
    "order_discount": nested.discount, "order_products": nested.products,
    "order_categories": nested.categories,
}.items():
    _detail_part(_name, _parts)


@query
def delivery_type(spark, sf):
    return _delivery_texts(spark, sf)


@query
def flatten_detail(spark, sf):
    return enrich.flatten_detail(fx.order_details(spark, sf))


@query
def collapse_orders(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("SLA "), "l_returnflag")).alias("sla_type"),
        F.when(F.col("l_linenumber") > 2, F.col("l_linestatus")).alias("uf"),
        F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("TR"), F.col("l_suppkey").cast("string")))
        .alias("tracking_number"),
        F.col("l_partkey").alias("sequence"),
        F.lit("dropped").alias("note"),
    )
    return enrich.collapse_orders(rows, ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


# --- extraction windows ------------------------------------------------------

@query
def window_plan(spark, sf):
    days = fx.table(spark, sf, "events").agg(
        F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day"))
    return windows.window_plan(days)


@query
def window_volume(spark, sf):
    return windows.window_volume(fx.table(spark, sf, "events"), "ts", cap=EVENT_CAP)


@query
def capped_extract(spark, sf):
    events = fx.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    return windows.capped_extract(events, "ts", ["event_id"], cap=EVENT_CAP)


# --- breakdowns, pipeline rules ----------------------------------------------

def _on(name: str, report: Callable, frame: Callable = fx.served) -> None:
    """Register a report, served from the stored frame unless it needs another."""
    REGISTRY[name] = lambda spark, sf: report(frame(spark, sf))


for _name in ("kpis", "monthly_evolution", "ledger_monthly", "by_source", "by_reason", "by_payment_method",
              "by_interaction", "by_antifraud_status", "by_state", "by_city", "by_delivery", "by_delivery_detail",
              "by_category", "by_item", "by_store", "cross_validation", "top_emails", "by_conversion",
              "by_record_type", "monthly_summary", "type_totals", "top_records"):
    _on(_name, getattr(metrics, _name))
_on("by_reason_profile", lambda df: metrics.by_reason(df, C.TOP_REASONS_PROFILE))
_on("by_category_documents", lambda df: metrics.by_category(df, "text"),
    lambda spark, sf: fx.table(spark, sf, "documents"))
_on("by_record_type_all", metrics.by_record_type, fx.raw_disputes)
_on("recurrence_tier", lambda df: metrics.recurrence_tier(metrics.value_counts(df, "shopper_email")))
_on("share_of_total", lambda df: metrics.share_of_total(metrics.by_payment_method(df)))


@query
def top_records_joined(spark, sf):
    """The same report without a stored frame: rows picked first, then joined."""
    rows = fx.disputes(spark, sf, "dispute_reason", "payment_method")
    few = consolidation.enrich_few(
        metrics.largest(rows, ROW_ID), fx.disputes(spark, sf), fx.ledger(spark, sf),
        fx.antifraud(spark, sf), fx.order_details(spark, sf))
    return metrics.top_records(few)


@query
def kpis_joined(spark, sf):
    """The same figures straight from the joined feeds."""
    return metrics.kpis(fx.reconciled(spark, sf))


# --- breakdowns, dashboard rules ---------------------------------------------

def _dash(name: str, report: Callable) -> None:
    _on(name, lambda df: report(df, start=DASH_START, end=DASH_END))


_dash("dash_group_count", lambda df, **r: dash.dash_group_count(df, "shopper_interaction", **r))
for _name in ("dash_kpis", "dash_monthly", "dash_reason", "dash_method", "dash_status", "dash_delivery",
              "dash_state", "dash_city", "dash_store", "dash_item", "dash_category", "dash_source",
              "dash_conversion", "dash_cross_validation", "dash_top_records"):
    _dash(_name, getattr(dash, _name))


# --- outputs -----------------------------------------------------------------

@query
def dashboard_sections(spark, sf):
    """All label breakdowns of the document as rows, from the stored frame."""
    return consolidation.dashboard_sections(fx.served(spark, sf))


@query
def dashboard_document(spark, sf):
    """The whole document, a row a section, with the time of the report given."""
    return consolidation.dashboard_document(fx.served(spark, sf), generated=REPORT_TIME, stored=True)


@query
def raw_export(spark, sf):
    return exports.raw_export(fx.served(spark, sf), keep=ROW_ID)


@query
def chargeback_extract(spark, sf):
    return consolidation.chargeback_extract(_outer(spark, sf))


@query
def notification_extract(spark, sf):
    return consolidation.notification_extract(_outer(spark, sf))


@query
def conversion_extract(spark, sf):
    reports = fx.antifraud(spark, sf).select("vtex_order_id", F.col("cs_pedido").alias("clearsale_pedido"))
    outer = consolidation.outer_reconciliation(
        fx.disputes(spark, sf).select("dispute_id", "psp_reference", "record_type",
                                      "dispute_amount", "vtex_order_id"),
        fx.ledger(spark, sf).select("ordinal", "psp_reference_sap"), reports)
    return consolidation.conversion_extract(outer, ("dispute_id", "ordinal")).drop(match.FOUND)


@query
def outer_flow(spark, sf):
    """The older flow from numbered feeds to order attributes."""
    reports = fx.antifraud(spark, sf).select("vtex_order_id", F.col("cs_pedido").alias("clearsale_pedido"))
    rows = consolidation.outer_flow(
        fx.disputes(spark, sf).select("dispute_id", "psp_reference", "record_type", "vtex_order_id"),
        fx.ledger(spark, sf).select("ordinal", "psp_reference_sap"), reports,
        fx.order_attributes(spark, sf, "vtex_store", "vtex_cidade", "vtex_uf"))
    return rows.drop(match.FOUND)


@query
def preview(spark, sf):
    return exports.preview(fx.with_orders(spark, sf), order=ROW_ID)


@query
def profile_columns(spark, sf):
    return exports.profile_columns(fx.disputes(spark, sf, *fx.REPORT_ATTRIBUTES), order=ROW_ID)


# --- file layouts, written from the tables and scanned back ------------------
# Every file is written by Spark tasks under the shared folder, whole tables at
# a time, in the layouts the feeds arrive in.

def _csv(df: DataFrame, path: str, **options: str) -> None:
    writer = df.write.mode("append").option("header", "true").option("escape", '"')
    writer.options(**options).csv(path)


def _mixed_feed(spark, sf) -> str:
    """Dispute files: comma and ISO dates for even lines, semicolon and D/M/Y for odd ones."""
    path = fresh_path(spark, "disputes-csv")
    rows = fx.raw_disputes(spark, sf)
    even = F.pmod(F.xxhash64("dispute_id"), F.lit(2)) == 0
    shared = [
        F.col("record_type").alias("Record Type"), F.col("psp_reference").alias("Psp Reference"),
        F.col("dispute_amount").alias("Dispute Amount"), F.col("metadata").alias("Metadata"),
        F.col("dispute_id").alias("Merchant Reference"),
    ]
    iso = F.date_format("record_date", "yyyy-MM-dd").alias("Record Date")
    day_first = F.date_format("record_date", "dd/MM/yyyy").alias("Record Date")
    _csv(rows.where(even).select(*shared, iso), path, sep=",")
    _csv(rows.where(~even).select(day_first, F.col("shopper_interaction").alias("Shopper Interaction"),
                                  *shared), path, sep=";")
    return path


@query
def scan_delimited(spark, sf):
    """Both layouts stacked by column name, each file with its own delimiter."""
    rows = delimited.scan_delimited(spark, _mixed_feed(spark, sf), source_file="source_file")
    return rows.select(
        F.col("Merchant Reference").alias("dispute_id"), F.col("Record Type").alias("record_type"),
        F.col("Dispute Amount").alias("dispute_amount"), F.col("Metadata").alias("metadata"),
        F.endswith("source_file", F.lit(".csv")).alias("from_csv"))


@query
def load_disputes(spark, sf):
    """The dispute feed from its files: delimiter, date convention, amount, order id."""
    return file_feeds.load_disputes(spark, _mixed_feed(spark, sf)).select(
        F.col("merchant_reference").alias("dispute_id"), "record_type", "psp_reference",
        "dispute_amount", "record_date", "vtex_order_id")


def _report_columns():
    return ["PEDIDO", "STATUS DO CHARGEBACK", "CIDADE", "UF", "ITEM PRINCIPAL"]


@query
def scan_semicolon(spark, sf):
    """Report files in UTF-8 and Latin-1; the cities get an accent to tell them apart."""
    path = fresh_path(spark, "reports-csv")
    rows = fx.raw_antifraud(spark, sf).withColumn("CIDADE", F.concat(F.lit("São "), "CIDADE"))
    latin = F.col("ordinal") % 3 == 0
    columns = _report_columns()
    _csv(rows.where(latin).select(*columns), path, sep=";", encoding="ISO-8859-1")
    _csv(rows.where(~latin).select(*columns), path, sep=";", encoding="UTF-8")
    scanned = delimited.scan_semicolon(spark, path, must_have="PEDIDO")
    return scanned.select(*[F.col(c).alias(c.lower().replace(" ", "_")) for c in columns])


HTML_ROWS = 500  # rows of one report page


def _report_pages(spark, sf) -> str:
    """Report pages, each a table of a bounded number of rows, as one file per page."""
    path = fresh_path(spark, "reports-html")
    columns = _report_columns()

    def table_row(tag: str, cells) -> Column:
        return F.concat(F.lit("<tr>"), *[
            x for c in cells for x in (F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))], F.lit("</tr>"))

    def escaped(c: str) -> Column:
        value = F.coalesce(F.col(c), F.lit(""))
        return F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    page = F.floor(F.col("ordinal") / (2 * HTML_ROWS)).alias("page")  # ordinals come in pairs
    head = table_row("th", [F.lit(c) for c in columns])
    pages = (
        fx.raw_antifraud(spark, sf)
        .select(page, F.struct("ordinal", table_row("td", [escaped(c) for c in columns]).alias("row"))
                .alias("line"))
        .groupBy("page")
        .agg(F.array_sort(F.collect_list("line")).alias("lines"))
        .select(
            F.concat(F.lit("page"), F.col("page").cast("string")).alias("page"),
            F.concat(F.lit("<html><p>report</p><table>"), head,
                     F.array_join(F.col("lines")["row"], ""), F.lit("</table></html>")).alias("value"))
    )
    pages.write.partitionBy("page").text(path)
    return path


@query
def scan_html_tables(spark, sf):
    """The pages read by folder, each parsed by one task."""
    pages = listing.Files.matching(_report_pages(spark, sf), "*.txt")
    scanned = documents.scan_html_tables(spark, pages)
    return scanned.select(*[F.col(c).alias(c.lower().replace(" ", "_")) for c in _report_columns()])


_PAGE = r"page=(page\d+)"


@query
def list_inputs(spark, sf):
    """The report pages as a listing: which there are, and how many files and bytes each has."""
    found = listing.list_inputs(spark, _report_pages(spark, sf), "*.txt", "*.html")
    return found.groupBy(F.regexp_extract("path", _PAGE, 1).alias("page")).agg(
        F.count("*").alias("n_files"), (F.sum("length") > 0).alias("filled"))


@query
def with_source_file(spark, sf):
    """Lines of the report pages tagged with their file, counted by page and file."""
    lines = spark.read.option("pathGlobFilter", "*.txt").text(_report_pages(spark, sf))
    tagged = listing.with_source_file(lines)
    return tagged.groupBy("page").agg(
        F.countDistinct("source_file").alias("n_files"), F.count("*").alias("n_lines"),
        F.bool_and(F.endswith("source_file", F.lit(".txt"))).alias("named"))


@query
def resolve_column(spark, sf):
    """Ledger columns found by parts of their headers, in an export that names them its own way."""
    raw = fx.raw_ledger(spark, sf)
    export = raw.select(
        "ordinal", F.lit("object").alias("Denominação do objeto"),
        F.col("denominacao_sap").alias("Denominação da conta"),
        F.col("data_lancamento_sap").alias("DATA DE LANÇAMENTO"), F.col("valor_sap").alias("Montante em moeda"))
    found = feeds.ledger_columns(export.columns)
    return export.select("ordinal", *(F.col(f"`{old}`").alias(new) for new, old in found.items()))


WORKBOOK_ROWS = 1000  # rows of one workbook


def _workbook(rows: list[list]) -> bytes:
    """A small spreadsheet package: text cells inline, numbers as they are."""
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    out = []
    for i, row in enumerate(rows, 1):
        cells = "".join(
            f'<c r="{chr(65 + j)}{i}"><v>{v}</v></c>' if isinstance(v, (int, float))
            else f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
            for j, v in enumerate(row) if v is not None)
        out.append(f'<row r="{i}">{cells}</row>')
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/worksheets/sheet1.xml",
                      f'<worksheet xmlns="{ns}"><sheetData>{"".join(out)}</sheetData></worksheet>')
    return data.getvalue()


def _ledger_workbooks(spark, sf) -> DataFrame:
    """The raw ledger as workbooks (path, content) in two layouts.

    One has day numbers and narrative first, the other day-first texts and the
    amount first.  A workbook holds a bounded number of rows.
    """
    rows = fx.raw_ledger(spark, sf).select(
        F.floor(F.col("ordinal") / (2 * WORKBOOK_ROWS)).alias("page"), "denominacao_sap", "valor_sap",
        F.date_diff(F.col("data_lancamento_sap"), F.lit("1899-12-30").cast("date")).alias("day"),
        F.date_format("data_lancamento_sap", "dd/MM/yyyy").alias("text"))

    def pack(page: pd.DataFrame) -> pd.DataFrame:
        number = int(page["page"].iloc[0])
        if number % 2:
            head, columns = ["Montante", "Lançamento", "Denominação da conta"], ["valor_sap", "text", "denominacao_sap"]
        else:
            head, columns = ["Denominação", "Data de lançamento", "Valor"], ["denominacao_sap", "day", "valor_sap"]
        cells = [[int(v) if c == "day" else v for c, v in zip(columns, r, strict=True)]
                 for r in page[columns].itertuples(index=False)]
        return pd.DataFrame({"path": [f"ledger/{number}.xlsx"], "content": [_workbook([head, *cells])]})

    return rows.groupBy("page").applyInPandas(pack, "path string, content binary")


@query
def scan_workbooks(spark, sf):
    """Both layouts of the workbooks stacked by column name."""
    cells = documents.cells_of(_ledger_workbooks(spark, sf), documents.workbook_rows)
    return documents.named_cells(cells).select(
        F.coalesce("Denominação", "Denominação da conta").alias("denominacao_sap"),
        F.coalesce("Valor", "Montante").alias("valor_sap"),
        F.coalesce("Data de lançamento", "Lançamento").alias("placed"))


@query
def load_ledger(spark, sf):
    """Chargeback postings from workbooks whose headers differ: columns by layout, typed values."""
    cells = documents.cells_of(_ledger_workbooks(spark, sf), documents.workbook_rows)
    return file_feeds.ledger_of_cells(cells).select(
        "denominacao_sap", "psp_reference_sap", "nsu", "data_lancamento_sap", "valor_sap",
        F.col("valor_sap_numero").cast("decimal(18,2)").alias("valor_sap_numero"))


def _report_files(spark, sf) -> str:
    """Report files of two exports; an order may be in both, and the later one (``.csv``) counts."""
    path = fresh_path(spark, "reports")
    rows, later = fx.raw_antifraud(spark, sf), F.col("ordinal") % 2 == 1
    _csv(rows.where(~later).select(*_report_columns()), path, sep=";", extension="xls")
    _csv(rows.where(later).select(*_report_columns()), path, sep=";")
    return path


@query
def load_antifraud(spark, sf):
    """The report feed from its files under the prefix of the older flow."""
    return file_feeds.load_antifraud(spark, _report_files(spark, sf), "clearsale_").drop("clearsale_source_file_cs", "source_file_cs")


@query
def outer_from_files(spark, sf):
    """The older flow from files to the conversion extract: load, outer join, provenance."""
    disputes = file_feeds.load_disputes(spark, _mixed_feed(spark, sf)).select(
        "dispute_id", F.col("merchant_reference").alias("dispute"), "psp_reference", "record_type", "vtex_order_id")
    cells = documents.cells_of(_ledger_workbooks(spark, sf), documents.workbook_rows)
    postings = file_feeds.ledger_of_cells(cells).select("ordinal", "psp_reference_sap")
    reports = file_feeds.load_antifraud(spark, _report_files(spark, sf), "clearsale_")
    outer = consolidation.outer_reconciliation(disputes, postings, reports)
    return consolidation.conversion_extract(outer, ("dispute_id", "ordinal")).select(
        F.col("dispute").alias("dispute_id"), "psp_reference", "record_type", "vtex_order_id",
        "psp_reference_sap", "virou_chargeback", "fonte")


@query
def scan_order_export(spark, sf):
    """Order export with a byte order mark, several rows per order, then one row per order."""
    path = fresh_path(spark, "orders-csv")
    rows = fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("\ufeffOrder"),
        F.lpad(F.col("l_linenumber").cast("string"), 3, "0").alias("Sequence"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("Status"),
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("Creation Date"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("Total Value"),
        F.col("l_partkey").alias("Part"), F.col("l_suppkey").alias("Supplier"),
    )
    _csv(rows, path, sep=";")
    scanned = orders.scan_order_export(spark, path)
    place = [F.col(c).cast("bigint").alias(c) for c in ("Part", "Supplier")]
    typed = scanned.select("order_id", "sequence", "status_description", "creation_date",
                           "total_value", *place)
    return enrich.collapse_orders(typed, ["sequence", "Part", "Supplier", "total_value"])


@query
def scan_cache(spark, sf):
    """The order cache written with its declared schema and read back."""
    path = fresh_path(spark, "cache")
    wanted = feeds.valid_order_ids(fx.disputes(spark, sf))
    at = F.lit("2025-01-02").cast("timestamp_ntz")
    resolved = enrich.resolve_candidates(wanted, fx.order_attributes(spark, sf))
    enrich.as_cache(resolved, at).write.parquet(path)
    return orders.scan_cache(spark, path)


@query
def consolidated_extracts(spark, sf):
    """Rows of each written extract."""
    path = fresh_path(spark, "extracts")
    written = exports.consolidated_extracts(fx.consolidated(spark, sf, *fx.REPORT_ATTRIBUTES), path)
    counts = [
        spark.read.parquet(target).agg(F.count("*").alias("n_rows"))
        .select(F.lit(name).alias("extract"), "n_rows") for name, target in written.items()
    ]
    return feeds.union_by_name(counts)


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
