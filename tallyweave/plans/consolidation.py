"""End-to-end plans composed of the operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyweave import constants as C
from tallyweave.functions import dates, text
from tallyweave.operators import enrich, feeds, ids, match, metrics
from tallyweave.operators.skew import KeyProfile, lookup_join
from tallyweave.session import cut_lineage


def consolidate(
    disputes: DataFrame, ledger: DataFrame, antifraud: DataFrame, attributes: DataFrame,
    row_id: Sequence[str] = match.ROW_ID, keys: DataFrame | None = None,
    profile: match.DisputeProfile | None = None,
) -> DataFrame:
    """Reconciled disputes with the attributes of their order documents.

    Two shuffles of the disputes: by reference (ledger, conversion) and by base
    order id (antifraud, documents).  A report is keyed by an undashed id, which
    is its own base, so it meets its disputes there too; the extra condition
    keeps dashed ids from matching it.  That is a mark on the disputes: the wanted id,
    compared with the report's, would be a second join key and ask for a shuffle more.
    Where many disputes have no order id, those go past the second shuffle.
    """
    if profile is None:
        profile = match.profile_disputes(disputes if keys is None else keys, "reference", "base_order")
    rows = match.match_by_reference(disputes, ledger, row_id, keys=keys, profile=profile)
    reports = match.report_lookup(antifraud)
    lookups = [(reports, "_report_order", F.col("_own_base")), (enrich.documents_by_base(attributes), "_base", enrich.fits())]
    keyed, unnamed = enrich.key_by_base(rows), F.col("vtex_order_id").isNull()
    if profile.base_order.hot_null:
        named = lookup_join(keyed.where(~unnamed), "_order", lookups, row_id, replace(profile.base_order, hot_null=False))
        joined = named.unionByName(keyed.where(unnamed), allowMissingColumns=True)
    else:
        joined = lookup_join(keyed, "_order", lookups, row_id, profile.base_order)
    columns = [*rows.columns, *[c for c in reports.columns if c != "_report_order"]]
    picked = enrich.pick_document(joined, columns, attributes.columns)
    return match.label_provenance(picked).drop("matched_id")


def consolidate_cached(
    disputes: DataFrame, ledger: DataFrame, antifraud: DataFrame, cache: DataFrame,
    row_id: Sequence[str] = match.ROW_ID,
) -> DataFrame:
    """As :func:`consolidate`, from a cache of attributes already found per order id."""
    profile = match.profile_disputes(disputes, "reference", "order")
    rows = match.reconcile(disputes, ledger, antifraud, row_id, profile=profile)
    return enrich.attach_enrichment(rows, cache, row_id, profile=profile.order)


def outer_reconciliation(
    disputes: DataFrame, ledger: DataFrame, antifraud: DataFrame,
    row_id: Sequence[str] = match.ROW_ID, ledger_id: Sequence[str] = ("ordinal",),
    prefix: str = "clearsale_", profile: match.DisputeProfile | None = None,
) -> DataFrame:
    """The older view: every posting is kept, also those without a dispute.

    Frequent orders are looked for among the disputes (see :func:`_of_outer`).
    """
    if profile is None:
        profile = match.profile_disputes(disputes, "order")
    rows = match.match_ledger_outer(disputes, ledger, row_id, ledger_id)
    return match.match_antifraud(rows, antifraud, (*row_id, *ledger_id), _of_outer(profile.order), prefix)


def _of_outer(profile: KeyProfile) -> KeyProfile:
    """The profile of a key of the disputes for the rows of the outer match.

    A profile of those rows themselves would run the outer join once more.  Postings
    without a dispute have no order, so null is taken for frequent.  An order that gets
    frequent only by many postings of its reference is left to Spark's skew join.
    """
    return replace(profile, hot_null=True)


def outer_flow(
    disputes: DataFrame, ledger: DataFrame, antifraud: DataFrame, attributes: DataFrame,
    row_id: Sequence[str] = match.ROW_ID, ledger_id: Sequence[str] = ("ordinal",),
    prefix: str = "clearsale_",
) -> DataFrame:
    """The older flow whole: both feeds numbered in load order (``adyen_id``, ``sap_id``),
    every posting kept, reports and the attributes of order documents beside.

    Postings without a dispute have no order, hence no report and no attributes.
    """
    numbered = ids.dense_ids(disputes, row_id, "adyen_id")
    profile = match.profile_disputes(numbered, "order", "base_order")
    rows = outer_reconciliation(
        numbered, ids.dense_ids(ledger, ledger_id, "sap_id"), antifraud, row_id, ledger_id, prefix, profile)
    return enrich.attach_documents(rows, attributes, (*row_id, *ledger_id),
                                   profile=_of_outer(profile.base_order)).drop("matched_id")


def chargeback_extract(outer: DataFrame) -> DataFrame:
    return feeds.filter_record_types(outer, [C.CHARGEBACK])


def notification_extract(outer: DataFrame) -> DataFrame:
    return feeds.filter_record_types(outer, [C.NOTIFICATION])


def conversion_extract(
    outer: DataFrame, row_id: Sequence[str], prefix: str = "clearsale_"
) -> DataFrame:
    """Both dispute types with conversion flag and provenance in front.

    The rows are stored first: the flag looks at them several times, and the
    outer join behind them should run once.
    """
    rows = cut_lineage(feeds.filter_record_types(outer), compression="zstd")
    flagged = match.flag_noc_conversion_v2(rows, row_id)
    labelled = match.label_provenance(flagged, prefix)
    return feeds.move_to_front(labelled, ["virou_chargeback", "fonte"])


def enrich_few(
    few: DataFrame, disputes: DataFrame, ledger: DataFrame, antifraud: DataFrame,
    documents: DataFrame, row_id: Sequence[str] = match.ROW_ID,
) -> DataFrame:
    """Join everything onto a small set of disputes, such as a top-100 report.

    The joins keep the row count, so the report's rows can be picked first.
    Each feed is then reduced to the few keys in question before it is joined;
    the keys are a stored table, whose size Spark knows when it picks the joins.
    """
    stored = cut_lineage(few)
    refs = stored.select("psp_reference").distinct()
    orders = feeds.valid_order_ids(stored)

    def of_refs(df: DataFrame, key: str) -> DataFrame:
        return df.join(refs, df[key] == refs["psp_reference"], "left_semi")

    def of_orders(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
        small = ids.select(ids.columns[0]).distinct()
        return df.join(small, df[key] == small[small.columns[0]], "left_semi")

    postings = match.dedup_first(of_refs(ledger, "psp_reference_sap"), "psp_reference_sap", "ordinal")
    charged = of_refs(match.chargeback_references(disputes), "_charged_ref")
    reports = of_orders(antifraud, "vtex_order_id", orders)
    tried = enrich.candidates(orders).select("candidate")
    flat = enrich.flatten_detail(of_orders(documents, "order_id", tried))
    attributes = enrich.resolve_candidates(orders, enrich.order_attributes(flat))

    by_ref = stored.join(postings.drop("ordinal"), stored["psp_reference"] == postings["psp_reference_sap"], "left")
    by_ref = by_ref.join(charged, by_ref["psp_reference"] == charged["_charged_ref"], "left")
    flagged = by_ref.withColumn(
        "virou_chargeback", match.conversion_flag(F.col("_charged_ref").isNotNull())
    ).drop("_charged_ref")
    few_reports = reports.withColumnRenamed("vtex_order_id", "_report_order")
    reported = flagged.join(
        few_reports, F.trim(flagged["vtex_order_id"]) == few_reports["_report_order"], "left"
    ).drop("_report_order")
    labelled = match.label_provenance(reported)  # no flag here: looks at the report's columns
    side = attributes.drop("matched_id").withColumnRenamed("order_id", "_cached_order")
    return labelled.join(
        side, F.trim(labelled["vtex_order_id"]) == side["_cached_order"], "left"
    ).drop("_cached_order")


# --- the dashboard document --------------------------------------------------

# Section names of the dashboard document and their lengths
SECTIONS = {
    "por_ferramenta": ("fonte", None),
    "por_motivo": ("dispute_reason", C.TOP_REASONS),
    "por_bandeira": ("payment_method", None),
    "cs_status_chargeback": ("cs_status_do_chargeback", None),
    "por_uf": ("uf_combined", None),
    "por_cidade": ("cidade_combined", C.TOP_CITIES),
    "por_entrega": ("delivery", None),
    "por_entrega_detalhe": ("vtex_delivery_type", C.TOP_DELIVERY_DETAIL),
    "por_categoria_vtex": ("categories", C.TOP_CATEGORIES),
    "por_produto_cs": ("cs_item_principal", C.TOP_ITEMS),
    "por_loja": ("vtex_store", C.TOP_STORES),
    "top_emails": ("shopper_email", C.TOP_EMAILS),
    "virou_chargeback": ("virou_chargeback", None),
    "record_types": ("record_type", None),
}
MONEY_SECTIONS = ("por_uf", "por_cidade")


def dashboard_sections(df: DataFrame) -> DataFrame:
    """All label breakdowns as rows (section, rank, label, n, total).

    A row contributes one entry per section, so the sections with a length are
    one partial aggregation and the others another, each reading its own
    columns.  Sections without a length keep all labels, unranked; the others
    are cut to their length before they meet in one task.
    """
    shaped = enrich.coalesce_location(df).withColumns({
        "delivery": text.classify_delivery("vtex_delivery_type"),
    })

    def entry(section: str, label: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), label.alias("label"))

    def counted(sections: dict[str, tuple[str, int | None]]) -> DataFrame:
        entries = F.array(*[
            entry(s, F.col(c)) for s, (c, _) in sections.items() if c in shaped.columns
        ])
        if any(c == "categories" for c, _ in sections.values()):
            names = F.transform(text.split_categories("vtex_categories"),
                                lambda x: entry("por_categoria_vtex", x))
            entries = F.concat(entries, F.coalesce(names, F.filter(entries, lambda _: F.lit(False))))
        money = F.col("section").isin(*MONEY_SECTIONS)
        return (
            shaped.select(F.explode(entries).alias("e"), metrics.AMOUNT)
            .where("e.label IS NOT NULL")
            .groupBy("e.section", "e.label")
            .agg(
                F.count("*").alias("n_rows"),
                F.count(metrics.AMOUNT).alias("n_amounts"),
                F.sum(metrics.AMOUNT).cast("double").alias("sum"),
            )
            .select("section", "label",
                    F.when(money, F.col("n_amounts")).otherwise(F.col("n_rows")).alias("n"),
                    F.when(money, F.col("sum")).alias("total"))
        )

    limited = {s: v for s, v in SECTIONS.items() if v[1] is not None}
    unlimited = {s: v for s, v in SECTIONS.items() if v[1] is None}
    lengths = {s: k for s, (_, k) in limited.items()}
    longest = max(lengths.values())
    length = F.create_map(*[x for s, k in lengths.items() for x in (F.lit(s), F.lit(k))])
    best = Window.partitionBy("section").orderBy(F.desc("n"), "label")
    ranked = (
        counted(limited)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= longest)
        .where(F.col("rank") <= F.try_element_at(length, F.col("section")))
    )
    whole = counted(unlimited).withColumn("rank", F.lit(None).cast("int"))
    cut = F.when(F.col("section") == "por_produto_cs", text.truncate_label("label"))
    return ranked.unionByName(whole).select(
        "section", "rank", F.coalesce(cut, F.col("label")).alias("label"), "n", "total"
    )


#: Names of the lists in a section
VALUE, COUNT, TOTAL = "values", "count", "total"


#: How figures other than counts are written.
FIGURE = "decimal(38,2)"


def _canonical(report: DataFrame) -> list[Column]:
    """The report's columns with figures and times as the document writes them."""
    shaped = []
    for f in report.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f.name)
        if kind in ("double", "decimal"):
            c = c.cast(FIGURE)
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        shaped.append(c.alias(f.name))
    return shaped


def _json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def dashboard_document(
    df: DataFrame, tiebreak: tuple[str, ...] = match.ROW_ID, period: str | None = None,
    generated: str | None = None, stored: bool = False,
) -> DataFrame:
    """The dashboard document, a row (section, json) for each of its top-level entries.

    A breakdown is ``{labels, values}``, or ``{labels, count, total}`` where it
    has amounts; the monthly series are ``{labels, ..}`` with a list per figure.
    A section is as long as it has labels.  The text is canonical: keys in a fixed
    order, figures other than counts with two decimals, times as ``yyyy-MM-dd HH:mm:ss``,
    missing values as nulls.  ``generated`` is the time of the report as text, by
    default now.  The frame is read several times, so it is stored first unless it already is.
    """
    stored = df if stored else cut_lineage(df)
    sections = dashboard_sections(stored)
    rows = F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "label", "n", "total"))),
        lambda r: F.struct(r["label"].alias("label"), r["n"].alias("n"), r["total"].alias("total")))
    lists = sections.groupBy("section").agg(rows.alias("r"))
    labels = F.col("r")["label"].alias("labels")
    totals = F.transform(F.col("r")["total"], lambda x: x.cast(FIGURE))
    money = _json(F.struct(labels, F.col("r")["n"].alias(COUNT), totals.alias(TOTAL)))
    plain = _json(F.struct(labels, F.col("r")["n"].alias(VALUE)))
    breakdowns = lists.select(
        "section", F.when(F.col("section").isin(*MONEY_SECTIONS), money).otherwise(plain).alias("json"))

    def one(section: str, report: DataFrame) -> DataFrame:
        """A report of one row as an object."""
        return report.select(F.lit(section).alias("section"), _json(F.struct(*_canonical(report))).alias("json"))

    def column_lists(report: DataFrame, groups: dict[str, tuple[str, ...]]) -> Column:
        """Lists by month; a group of several figures becomes an object of lists."""
        kept = {"month"} | {c for own in groups.values() for c in own}
        every = F.array_sort(F.collect_list(F.struct(*_canonical(report.select(*sorted(kept, key=report.columns.index))))))
        fields = [every["month"].alias("labels")]
        for name, own in groups.items():
            lists = [every[c].alias(c.rsplit("_", 1)[-1]) for c in own]
            fields.append(F.struct(*lists).alias(name))
        return _json(F.struct(*fields)).alias("json")

    monthly = metrics.monthly_evolution(stored)
    months = monthly.agg(column_lists(monthly, {
        "chargeback": ("cb_count", "cb_total"), "notification": ("noc_count", "noc_total")}))
    postings = metrics.ledger_monthly(stored).agg(
        F.array_sort(F.collect_list(F.struct("month", "n", F.col("total").cast(FIGURE).alias("total")))).alias("r")
    ).select(_json(F.struct(F.col("r")["month"].alias("labels"), F.col("r")["n"].alias(COUNT),
                                F.col("r")["total"].alias(TOTAL))).alias("json"))
    amount = F.col(metrics.AMOUNT)
    largest = F.struct(amount.isNull().alias("missing"), (-amount).alias("size"), *tiebreak)
    top = metrics.top_records(stored, tiebreak)
    records = top.agg(_json(F.array_sort(F.collect_list(F.struct(
        largest.alias("order"), F.struct(*_canonical(top)).alias("row"))))["row"]).alias("json"))
    span = stored.agg(_json(F.struct(
        F.coalesce(F.lit(period), F.concat(
            dates.month_label(dates.month_key(F.min("record_date"))), F.lit(" — "),
            dates.month_label(dates.month_key(F.max("record_date"))))).alias("periodo"),
        F.coalesce(F.lit(generated), F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))
        .alias("gerado_em"))).alias("json"))
    named = {"evolucao_mensal": months, "sap_mensal": postings, "top_registros": records, "meta": span}
    return reduce(DataFrame.unionByName, (
        breakdowns, one("kpis", metrics.kpis(stored)), one("cross_validation", metrics.cross_validation(stored)),
        *(frame.select(F.lit(section).alias("section"), "json") for section, frame in named.items())))
