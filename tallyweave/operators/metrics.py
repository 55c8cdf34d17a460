"""Breakdowns with the pipeline's rules: null labels are skipped, counts of
money breakdowns are of non-null amounts, ties are ordered by label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave import constants as C
from tallyweave.functions import dates, numbers, text
from tallyweave.operators.enrich import coalesce_location
from tallyweave.operators.match import has_antifraud, has_ledger

AMOUNT = "dispute_amount"


def _ranked(df: DataFrame, k: int | None) -> DataFrame:
    ordered = df.orderBy(F.desc("n"), F.asc("label"))
    return ordered if k is None else ordered.limit(k)


def value_counts(df: DataFrame, label: Column | str, k: int | None = None) -> DataFrame:
    """Rows per label, most frequent first; ``k`` keeps the top of the report.

    Rows without a label meet in one group per task and are dropped after
    grouping: a filter on the label would be pushed below the joins and
    evaluate a label parsed from a document once more for every row.
    """
    value = F.col(label) if isinstance(label, str) else label
    rows = df.select(value.alias("label"))
    return _ranked(rows.groupBy("label").agg(F.count("label").alias("n")).where("n > 0"), k)


def _money_counts(df: DataFrame, label: str, k: int | None = None) -> DataFrame:
    counted = (
        df.select(F.col(label).alias("label"), AMOUNT)
        .groupBy("label")
        .agg(
            F.count(AMOUNT).alias("n"),
            numbers.total(F.col(AMOUNT)).alias("total"),
            F.count("label").alias("labelled"),
        )
        .where("labelled > 0")
        .drop("labelled")
    )
    return _ranked(counted, k)


def _is(kind: str) -> Column:
    return F.col("record_type") == kind


def _amount_of(kind: str) -> Column:
    return F.when(_is(kind), F.col(AMOUNT))


def kpis(df: DataFrame, prefix: str = "cs_") -> DataFrame:
    """The 11 headline figures in one aggregate."""
    n_cb, n_noc = F.count_if(_is(C.CHARGEBACK)), F.count_if(_is(C.NOTIFICATION))
    converted = F.count_if(F.col("virou_chargeback") == C.CONVERTED)
    return df.agg(
        n_cb.alias("total_chargebacks"),
        n_noc.alias("total_notifications"),
        numbers.total(_amount_of(C.CHARGEBACK)).alias("valor_total_cb"),
        numbers.total(_amount_of(C.NOTIFICATION)).alias("valor_total_noc"),
        numbers.mean_amount(_amount_of(C.CHARGEBACK)).alias("ticket_medio_cb"),
        numbers.mean_amount(_amount_of(C.NOTIFICATION)).alias("ticket_medio_noc"),
        converted.alias("noc_que_viraram_cb"),
        n_noc.alias("noc_total"),
        numbers.percent(converted, n_noc).alias("taxa_conversao_noc_cb"),
        F.count_if(has_ledger()).alias("com_sap"),
        F.count_if(has_antifraud(df, prefix)).alias("com_clearsale"),
    )


def monthly_evolution(df: DataFrame) -> DataFrame:
    """Count and total of each record type per month, zero where a type is absent."""
    by_month = df.where(F.col("record_date").isNotNull()).groupBy(
        dates.month_key("record_date").alias("month")
    )
    return by_month.agg(
        F.count(_amount_of(C.CHARGEBACK)).alias("cb_count"),
        numbers.total(_amount_of(C.CHARGEBACK)).alias("cb_total"),
        F.count(_amount_of(C.NOTIFICATION)).alias("noc_count"),
        numbers.total(_amount_of(C.NOTIFICATION)).alias("noc_total"),
    ).orderBy("month")


def ledger_monthly(df: DataFrame) -> DataFrame:
    """Ledger values of matched rows by dispute month, once per dispute row."""
    value = numbers.try_numeric("valor_sap", numbers.MONEY)
    return (
        df.where(has_ledger() & F.col("record_date").isNotNull())
        .select(dates.month_key("record_date").alias("month"), value.alias("v"))
        .groupBy("month")
        .agg(F.count("v").alias("n"), numbers.total(F.col("v")).alias("total"))
        .orderBy("month")
    )


def by_source(df: DataFrame) -> DataFrame:
    return value_counts(df, "fonte")


def by_reason(df: DataFrame, k: int = C.TOP_REASONS) -> DataFrame:
    return value_counts(df, "dispute_reason", k)


def by_payment_method(df: DataFrame) -> DataFrame:
    return value_counts(df, "payment_method")


def by_interaction(df: DataFrame) -> DataFrame:
    return value_counts(df, "shopper_interaction")


def by_antifraud_status(df: DataFrame) -> DataFrame:
    return value_counts(df, "cs_status_do_chargeback")


def by_state(df: DataFrame) -> DataFrame:
    return _money_counts(coalesce_location(df), "uf_combined")


def by_city(df: DataFrame, k: int = C.TOP_CITIES) -> DataFrame:
    return _money_counts(coalesce_location(df), "cidade_combined", k)


def by_delivery(df: DataFrame) -> DataFrame:
    return value_counts(df, text.classify_delivery("vtex_delivery_type"))


def by_delivery_detail(df: DataFrame, k: int = C.TOP_DELIVERY_DETAIL) -> DataFrame:
    return value_counts(df, "vtex_delivery_type", k)


def by_category(df: DataFrame, column: str = "vtex_categories",
                k: int = C.TOP_CATEGORIES) -> DataFrame:
    return value_counts(df, F.explode(text.split_categories(column)), k)


def by_item(df: DataFrame, k: int = C.TOP_ITEMS) -> DataFrame:
    """Labels are cut after grouping, so two long items may show the same label."""
    top = value_counts(df, "cs_item_principal", k)
    return top.withColumn("label", text.truncate_label("label"))


def by_store(df: DataFrame, k: int = C.TOP_STORES) -> DataFrame:
    return value_counts(df, "vtex_store", k)


def cross_validation(df: DataFrame, prefix: str = "cs_") -> DataFrame:
    total = F.count("*")
    ledger, antifraud = F.count_if(has_ledger()), F.count_if(has_antifraud(df, prefix))
    return df.agg(
        total.alias("total_adyen_cb_noc"),
        ledger.alias("encontrados_no_sap"),
        (total - ledger).alias("nao_encontrados_sap"),
        numbers.percent(ledger, total).alias("taxa_match_sap"),
        antifraud.alias("encontrados_no_clearsale"),
        (total - antifraud).alias("nao_encontrados_clearsale"),
        numbers.percent(antifraud, total).alias("taxa_match_clearsale"),
    )


def top_emails(df: DataFrame, k: int = C.TOP_EMAILS) -> DataFrame:
    return value_counts(df, "shopper_email", k)


def by_conversion(df: DataFrame) -> DataFrame:
    return value_counts(df, "virou_chargeback")


def by_record_type(df: DataFrame) -> DataFrame:
    return value_counts(df, "record_type")


def largest(df: DataFrame, tiebreak: tuple[str, ...], k: int = C.TOP_RECORDS) -> DataFrame:
    """The ``k`` largest disputes; each task keeps ``k`` rows, nothing is shuffled whole."""
    return df.orderBy(F.desc_nulls_last(AMOUNT), *[F.asc(c) for c in tiebreak]).limit(k)


def top_records(df: DataFrame, tiebreak: tuple[str, ...] = ("dispute_id",),
                k: int = C.TOP_RECORDS) -> DataFrame:
    columns = [c for c in C.RAW_EXPORT_COLUMNS if c in df.columns]
    return largest(df, tiebreak, k).select(*tiebreak, *columns)


def monthly_summary(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("record_date").isNotNull())
        .groupBy(dates.month_key("record_date").alias("month"), "record_type")
        .agg(
            F.count(AMOUNT).alias("quantidade"),
            numbers.total(F.col(AMOUNT)).alias("valor_total"),
            # no amounts, no mean: null rather than zero
            numbers.as_double(
                F.round(F.try_divide(F.sum(numbers.money(F.col(AMOUNT))), F.count(AMOUNT)), 2)
            ).alias("ticket_medio"),
        )
        .orderBy("month", "record_type")
    )


def type_totals(df: DataFrame) -> DataFrame:
    return df.agg(
        numbers.total(_amount_of(C.CHARGEBACK)).alias("total_cb"),
        F.count_if(_is(C.CHARGEBACK)).alias("rows_cb"),
        numbers.total(_amount_of(C.NOTIFICATION)).alias("total_noc"),
        F.count_if(_is(C.NOTIFICATION)).alias("rows_noc"),
    )


def recurrence_tier(emails: DataFrame, threshold: int = C.RECURRENCE_DANGER) -> DataFrame:
    """Mark counted e-mails as danger from ``threshold`` occurrences on."""
    return emails.withColumn(
        "tier", F.when(F.col("n") >= threshold, "danger").otherwise("warning")
    )


def share_of_total(counts: DataFrame) -> DataFrame:
    """Each label's share in percent; the total is one scalar."""
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", numbers.percent(F.col("n"), total))
