"""Breakdowns with the dashboard's rules, for an optional month range.

They differ from ``metrics``: rows are counted whatever their amount, ``''``
and the text ``'nan'`` are missing values, rows without a date are dropped,
and locations have no fallback.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave import constants as C
from tallyweave.functions import dates, numbers, text
from tallyweave.operators.feeds import month_range_filter
from tallyweave.operators.match import has_ledger
from tallyweave.operators.metrics import AMOUNT, _amount_of, _is, _ranked, value_counts

Month = str | None


def dash_group_count(df: DataFrame, key: str | Column, k: int | None = None,
                     start: Month = None, end: Month = None) -> DataFrame:
    return value_counts(month_range_filter(df, start, end), text.present(key), k)


def _reported() -> Column:
    """An empty item or status is no report."""
    item, status = F.col("cs_item_principal"), F.col("cs_status_do_chargeback")
    return F.coalesce(F.nullif(item, F.lit("")), F.nullif(status, F.lit(""))).isNotNull()


def _mean_over_rows(amount: Column, rows: Column) -> Column:
    """Mean where a missing amount counts as zero; zero for no rows."""
    return F.coalesce(F.try_divide(numbers.total(amount), rows), F.lit(0.0))


def dash_kpis(df: DataFrame, start: Month = None, end: Month = None) -> DataFrame:
    n_cb, n_noc = F.count_if(_is(C.CHARGEBACK)), F.count_if(_is(C.NOTIFICATION))
    cb, noc = _amount_of(C.CHARGEBACK), _amount_of(C.NOTIFICATION)
    converted = F.count_if(F.col("virou_chargeback") == C.CONVERTED)
    return month_range_filter(df, start, end).agg(
        n_cb.alias("total_chargebacks"),
        n_noc.alias("total_notifications"),
        numbers.total(cb).alias("valor_total_cb"),
        numbers.total(noc).alias("valor_total_noc"),
        _mean_over_rows(cb, n_cb).alias("ticket_medio_cb"),
        _mean_over_rows(noc, n_noc).alias("ticket_medio_noc"),
        converted.alias("noc_que_viraram_cb"),
        n_noc.alias("noc_total"),
        numbers.percent(converted, n_noc).alias("taxa_conversao_noc_cb"),
        F.count_if(has_ledger()).alias("com_sap"),
        F.count_if(_reported()).alias("com_clearsale"),
    )


def dash_monthly(df: DataFrame, start: Month = None, end: Month = None) -> DataFrame:
    return (
        month_range_filter(df, start, end)
        .groupBy(dates.month_key("record_date").alias("month"))
        .agg(
            F.count_if(_is(C.CHARGEBACK)).alias("cb_count"),
            numbers.total(_amount_of(C.CHARGEBACK)).alias("cb_total"),
            F.count_if(_is(C.NOTIFICATION)).alias("noc_count"),
            numbers.total(_amount_of(C.NOTIFICATION)).alias("noc_total"),
        )
        .orderBy("month")
    )


def dash_reason(df: DataFrame, start: Month = None, end: Month = None) -> DataFrame:
    return dash_group_count(df, "dispute_reason", C.TOP_REASONS, start, end)


def dash_method(df: DataFrame, start: Month = None, end: Month = None) -> DataFrame:
    """Methods are upper-cased, after missing ones are dropped."""
    return value_counts(month_range_filter(df, start, end), text.upper_method("payment_method"))


def dash_status(df: DataFrame, start: Month = None, end: Month = None) -> DataFrame:
    return dash_group_count(df, "cs_status_do_chargeback", None, start, end)


def dash_delivery(df: DataFrame, start: Month = None, end: Month = None) -> DataFrame:
    kind = text.classify_delivery_dash("vtex_delivery_type")
    return value_counts(month_range_filter(df, start, end), kind)


def dash_state(df: DataFrame, start: Month = None, end: Month = None) -> DataFrame:
    counted = (
        month_range_filter(df, start, end)
        .select(text.present("vtex_uf").alias("label"), AMOUNT)
        .groupBy("label")
        .agg(F.count("label").alias("n"), numbers.total(F.col(AMOUNT)).alias("total"))
        .where("n > 0")
    )
    return _ranked(counted, None)


def dash_city(df: DataFrame, start: Month = None, end: Month = None) -> DataFrame:
    return dash_group_count(df, "vtex_cidade", C.TOP_CITIES, start, end)


def dash_store(df: DataFrame, start: Month = None, end: Month = None) -> DataFrame:
    return dash_group_count(df, "vtex_store", C.DASH_TOP_STORES, start, end)


def dash_item(df: DataFrame, start: Month = None, end: Month = None) -> DataFrame:
    return dash_group_count(df, "cs_item_principal", C.DASH_TOP_ITEMS, start, end)


def dash_category(df: DataFrame, start: Month = None, end: Month = None) -> DataFrame:
    names = F.explode(text.split_categories(text.present("vtex_categories")))
    return value_counts(month_range_filter(df, start, end), names, C.DASH_TOP_CATEGORIES)


def dash_source(df: DataFrame, start: Month = None, end: Month = None) -> DataFrame:
    return dash_group_count(df, "fonte", None, start, end)


def dash_conversion(df: DataFrame, start: Month = None, end: Month = None) -> DataFrame:
    return dash_group_count(df, "virou_chargeback", None, start, end)


def dash_cross_validation(df: DataFrame, start: Month = None, end: Month = None) -> DataFrame:
    """Here an order city also counts as an antifraud match."""
    seen = _reported() | F.coalesce(F.col("vtex_cidade") != "", F.lit(False))
    total, ledger, antifraud = F.count("*"), F.count_if(has_ledger()), F.count_if(seen)
    return month_range_filter(df, start, end).agg(
        total.alias("total_adyen_cb_noc"),
        ledger.alias("encontrados_no_sap"),
        (total - ledger).alias("nao_encontrados_sap"),
        numbers.percent(ledger, total).alias("taxa_match_sap"),
        antifraud.alias("encontrados_no_clearsale"),
        (total - antifraud).alias("nao_encontrados_clearsale"),
        numbers.percent(antifraud, total).alias("taxa_match_clearsale"),
    )


# Columns of the dashboard's table of single records
RECORD_COLUMNS = (
    "psp_reference", "record_type", "dispute_amount", "dispute_reason", "payment_method",
    "record_date", "virou_chargeback", "vtex_store", "vtex_cidade", "vtex_uf",
    "vtex_delivery_type",
)


def dash_top_records(df: DataFrame, start: Month = None, end: Month = None,
                     tiebreak: tuple[str, ...] = ("dispute_id",),
                     k: int = C.TOP_RECORDS) -> DataFrame:
    """The largest records, a missing amount ranking as zero."""
    rows = month_range_filter(df, start, end)
    ranked = rows.withColumn("_size", F.coalesce(F.col(AMOUNT), F.lit(0)))
    top = ranked.orderBy(F.desc("_size"), *[F.asc(c) for c in tiebreak]).limit(k)
    return top.select(*tiebreak, *[c for c in RECORD_COLUMNS if c in df.columns])
