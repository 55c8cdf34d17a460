"""Matching of disputes with the ledger and the antifraud reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave import constants as C
from tallyweave.functions import numbers, text
from tallyweave.functions.text import base_order_id
from tallyweave.operators.skew import (
    KeyProfile,
    fanout_join,
    first_per_key,
    lookup_join,
    profile_keys,
)

ROW_ID = ("dispute_id",)


def dedup_first(df: DataFrame, key: str, order: str) -> DataFrame:
    return first_per_key(df, [key], [F.asc(order)])


def dedup_last(df: DataFrame, key: str, order: str) -> DataFrame:
    return first_per_key(df, [key], [F.desc(order)])


def dedup_by_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First occurrence of each key in the given order."""
    return first_per_key(df, [key], [F.asc(c) for c in order])


def match_ledger(
    disputes: DataFrame,
    ledger: DataFrame,
    order: str = "ordinal",
    row_id: Sequence[str] = ROW_ID,
    null_keys: str = "never",
    profile: KeyProfile | None = None,
) -> DataFrame:
    """Left join with the first posting per reference.

    ``null_keys="match"`` lets postings without a reference meet disputes
    without one; by default null matches nothing.
    """
    first = dedup_first(ledger, "psp_reference_sap", order).drop(order)
    return lookup_join(disputes, "psp_reference", [(first, "psp_reference_sap")], row_id,
                       profile, match_nulls=null_keys == "match")


def match_ledger_outer(
    disputes: DataFrame,
    ledger: DataFrame,
    row_id: Sequence[str] = ROW_ID,
    ledger_id: Sequence[str] = ("ordinal",),
) -> DataFrame:
    """Full outer join on every posting; ledger-only rows are labelled as such.

    One join: postings without a dispute come out of the shuffle that matches the others.
    """
    joined = fanout_join(disputes.withColumn("_disputed", F.lit(True)), ledger, "psp_reference",
                         "psp_reference_sap", row_id, ledger_id, how="full")
    only = F.col("_disputed").isNull()
    return joined.withColumns({
        "record_type": F.when(only, C.LEDGER_ONLY).otherwise(F.col("record_type")),
        "psp_reference": F.when(only, F.col("psp_reference_sap")).otherwise(F.col("psp_reference")),
    }).drop("_disputed")


#: boolean that a matched report leaves on the dispute
FOUND = "antifraud_found"


def _reported(columns: Sequence[str], prefix: str) -> Column:
    """True when any prefixed column of a row has a value."""
    named = [F.col(c).cast("string") for c in columns if c.startswith(prefix)]
    return F.coalesce(*named).isNotNull() if named else F.lit(False)


def report_lookup(antifraud: DataFrame, prefix: str = "cs_") -> DataFrame:
    """Reports keyed by ``_report_order``, with a flag whether they say anything.

    The flag is made before the join, so that queries which only need to know
    that much do not shuffle the report's columns.
    """
    if not any(c.startswith(prefix) for c in antifraud.columns):
        raise ValueError(f"no report column begins with {prefix!r}")
    flagged = antifraud.withColumn(FOUND, _reported(antifraud.columns, prefix))
    return flagged.withColumnRenamed("vtex_order_id", "_report_order")


def match_antifraud(
    disputes: DataFrame,
    antifraud: DataFrame,
    row_id: Sequence[str] = ROW_ID,
    profile: KeyProfile | None = None,
    prefix: str = "cs_",
) -> DataFrame:
    """Left join on the trimmed order id; the report holds one row per order."""
    keyed = disputes.withColumn("_order", F.trim("vtex_order_id"))
    return lookup_join(keyed, "_order", [(report_lookup(antifraud, prefix), "_report_order")],
                       row_id, profile).drop("_order", "_report_order")


def chargeback_references(disputes: DataFrame) -> DataFrame:
    return (
        disputes.where((F.col("record_type") == C.CHARGEBACK) & F.col("psp_reference").isNotNull())
        .select(F.col("psp_reference").alias("_charged_ref"))
        .distinct()
    )


def conversion_flag(has_chargeback: Column) -> Column:
    kind = F.col("record_type")
    return (
        F.when(kind == C.CHARGEBACK, C.IS_CHARGEBACK)
        .when(kind == C.NOTIFICATION,
              F.when(has_chargeback, C.CONVERTED).otherwise(C.NOT_CONVERTED))
        .otherwise(C.NOT_APPLICABLE)
    )


def flag_noc_conversion(
    disputes: DataFrame, row_id: Sequence[str] = ROW_ID, profile: KeyProfile | None = None
) -> DataFrame:
    """Did the reference of an early notification become a chargeback?"""
    refs = chargeback_references(disputes)
    joined = lookup_join(disputes, "psp_reference", [(refs, "_charged_ref")], row_id, profile)
    flag = conversion_flag(F.col("_charged_ref").isNotNull())
    return joined.withColumn("virou_chargeback", flag).drop("_charged_ref")


def flag_noc_conversion_v2(
    disputes: DataFrame, row_id: Sequence[str] = ROW_ID, profile: KeyProfile | None = None
) -> DataFrame:
    """Variant: a chargeback counts as converted; without any chargeback nothing does."""
    refs = chargeback_references(disputes)
    joined = lookup_join(disputes, "psp_reference", [(refs, "_charged_ref")], row_id, profile)
    kind = F.col("record_type")
    any_chargeback = (
        disputes.select((kind == C.CHARGEBACK).alias("x"))
        .agg(F.coalesce(F.bool_or("x"), F.lit(False)))
        .scalar()
    )
    flag = (
        F.when(~any_chargeback, C.NOT_CONVERTED)
        .when(kind == C.CHARGEBACK, C.CONVERTED)
        .when(kind == C.NOTIFICATION,
              F.when(F.col("_charged_ref").isNotNull(), C.CONVERTED).otherwise(C.NOT_CONVERTED))
    )
    return joined.withColumn("virou_chargeback", flag).drop("_charged_ref")


def has_ledger() -> Column:
    return F.col("psp_reference_sap").isNotNull()


def has_antifraud(df: DataFrame, prefix: str = "cs_") -> Column:
    """True when any prefixed column of the row has a value."""
    if FOUND in df.columns:
        return F.coalesce(F.col(FOUND), F.lit(False))
    return _reported(df.columns, prefix)


def label_provenance(df: DataFrame, prefix: str = "cs_") -> DataFrame:
    return df.withColumn("fonte", text.provenance(has_ledger(), has_antifraud(df, prefix)))


def match_rates(df: DataFrame, prefix: str = "cs_") -> DataFrame:
    """Matched rows, all rows and percentage for each feed, in one pass."""
    total = F.count("*")
    feeds = {
        "ledger": has_ledger(),
        "order_id": F.col("vtex_order_id").isNotNull(),
        "antifraud": has_antifraud(df, prefix),
    }
    figures = [total.alias("total")]
    for feed, test in feeds.items():
        figures.append(F.count_if(test).alias(f"{feed}_matched"))
        figures.append(numbers.percent(F.count_if(test), total).alias(f"{feed}_pct"))
    return df.agg(*figures)


def record_type_set(df: DataFrame) -> DataFrame:
    return df.select("record_type").distinct()


@dataclass(frozen=True)
class DisputeProfile:
    """Frequent references, order ids and base order ids of the dispute feed; None where not looked for."""

    reference: KeyProfile | None = None
    order: KeyProfile | None = None
    base_order: KeyProfile | None = None


def profile_disputes(disputes: DataFrame, *keys: str) -> DisputeProfile:
    """Profile the named join keys of the feed (all by default) in one pass, to be used for every join of it."""
    order = F.trim("vtex_order_id")
    known = {"reference": F.col("psp_reference"), "order": order, "base_order": base_order_id(order)}
    return DisputeProfile(**profile_keys(disputes, {k: known[k] for k in keys or known}))


def match_by_reference(
    disputes: DataFrame,
    ledger: DataFrame,
    row_id: Sequence[str] = ROW_ID,
    null_keys: str = "never",
    keys: DataFrame | None = None,
    profile: DisputeProfile | None = None,
) -> DataFrame:
    """Ledger posting and conversion flag, from one shuffle of the disputes.

    ``keys`` may name a narrower frame of the same disputes, from which record
    types and keys are read more cheaply.
    """
    keys = disputes if keys is None else keys
    hot = (profile_disputes(keys, "reference") if profile is None else profile).reference
    first = dedup_first(ledger, "psp_reference_sap", "ordinal").drop("ordinal")
    postings, refs = (first, "psp_reference_sap"), (chargeback_references(keys), "_charged_ref")
    if null_keys == "match":
        rows = lookup_join(disputes, "psp_reference", [postings], row_id, hot, match_nulls=True)
        rows = lookup_join(rows, "psp_reference", [refs], row_id, hot)
    else:
        rows = lookup_join(disputes, "psp_reference", [postings, refs], row_id, hot)
    flag = conversion_flag(F.col("_charged_ref").isNotNull())
    return rows.withColumn("virou_chargeback", flag).drop("_charged_ref")


def reconcile(
    disputes: DataFrame,
    ledger: DataFrame,
    antifraud: DataFrame,
    row_id: Sequence[str] = ROW_ID,
    null_keys: str = "never",
    keys: DataFrame | None = None,
    profile: DisputeProfile | None = None,
) -> DataFrame:
    """Disputes with ledger posting, antifraud report, conversion flag and provenance.

    ``disputes``, ``ledger`` and ``antifraud`` come from the ``prepare_*``
    functions; for ``keys`` see :func:`match_by_reference`.
    """
    profile = profile_disputes(disputes if keys is None else keys, "reference", "order") if profile is None else profile
    rows = match_by_reference(disputes, ledger, row_id, null_keys, keys, profile)
    return label_provenance(match_antifraud(rows, antifraud, row_id, profile.order))
