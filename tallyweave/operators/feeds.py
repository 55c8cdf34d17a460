"""Shaping of the three feeds before they are matched."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave import constants as C
from tallyweave.functions import dates, numbers, text
from tallyweave.operators.skew import first_per_key, lookup_join


#: Partition column of a frame stored by month.
STORED_MONTH = "stored_month"


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name; columns a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of the table has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def resolve_column(
    columns: Sequence[str],
    contains: Sequence[str],
    excludes: Sequence[str] = (),
    ignore_case: bool = False,
) -> str | None:
    """First header holding one of the texts and none of the excluded ones."""

    def fold(name: str) -> str:
        return name.lower() if ignore_case else name

    wanted, barred = [fold(x) for x in contains], [fold(x) for x in excludes]
    matches = (
        c for c in columns
        if any(w in fold(c) for w in wanted) and not any(b in fold(c) for b in barred)
    )
    return next(matches, None)


def rename_select(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Keep the mapped columns that exist, under their new names, in mapping order."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items() if old in df.columns])


def prefix_columns(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Lower-case names with underscores behind a prefix, except the kept keys."""
    names = {c: prefix + c.lower().replace(" ", "_") for c in df.columns if c not in keep}
    return df.withColumnsRenamed(names)


def move_to_front(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    lead = [c for c in cols if c in df.columns]
    return df.select(*lead, *[c for c in df.columns if c not in lead])


def filter_record_types(
    df: DataFrame, types: Sequence[str] = C.RECORD_TYPES, column: str = "record_type"
) -> DataFrame:
    return df.where(F.col(column).isin(*types))


def extract_order_id(df: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Add the order id; a feed without metadata has none."""
    known = metadata in df.columns
    order_id = text.order_id_from_metadata(metadata) if known else F.lit(None).cast("string")
    return df.withColumn("vtex_order_id", order_id)


def filter_narrative(df: DataFrame, column: str, wanted: str = C.NARRATIVE_TEXT) -> DataFrame:
    return df.where(text.mentions(column, wanted))


def normalize_mixed_dates(
    df: DataFrame, cols: Sequence[str], file_col: str, row_id: Sequence[str]
) -> DataFrame:
    """Parse text dates by the convention of their file.

    A file whose column holds a slash anywhere is read day-first.  The flags
    are one aggregate row per file; the file that holds a large share of the
    rows is spread like any other frequent key.
    """
    flags = df.groupBy(F.col(file_col).alias("_file")).agg(
        *[F.max(F.contains(F.col(c), F.lit("/"))).alias(f"_slash_{c}") for c in cols]
    )
    out = lookup_join(df, file_col, [(flags, "_file")], row_id)
    for c in cols:
        day_first = F.coalesce(F.col(f"_slash_{c}"), F.lit(False))
        out = out.withColumn(c, dates.parse_mixed_date(c, day_first))
    return out.drop("_file", *[f"_slash_{c}" for c in cols])


def prepare_disputes(df: DataFrame) -> DataFrame:
    """Chargebacks and notifications with their order id."""
    return extract_order_id(filter_record_types(df))


def prepare_ledger(df: DataFrame) -> DataFrame:
    """Chargeback postings with reference and number taken from the narrative.

    Expects the canonical names ``denominacao_sap``, ``data_entrada_sap``,
    ``data_lancamento_sap`` and ``valor_sap`` (see :func:`canonical_ledger`).
    """
    kept = filter_narrative(df, "denominacao_sap")
    return (
        kept.withColumn("psp_reference_sap", text.psp_reference("denominacao_sap"))
        .withColumn("nsu", text.nsu_suffix("denominacao_sap"))
        .withColumn("tipo", F.lit(C.NARRATIVE_TEXT))
    )


def ledger_columns(cols: Sequence[str]) -> dict[str, str]:
    """Canonical names of a ledger layout, which vary between exports; none without a narrative."""
    found = {
        # Parts of the ledger headers
        "denominacao_sap": resolve_column(cols, ["Denomina"], ["objeto"]),
        "data_entrada_sap": resolve_column(cols, ["entrada"], ignore_case=True),
        "data_lancamento_sap": resolve_column(cols, ["lançamento", "lanç"], ignore_case=True),
        "valor_sap": resolve_column(cols, ["Valor", "Montante"]),
    }
    if found["denominacao_sap"] is None:
        return {}
    return {new: old for new, old in found.items() if old is not None}


def canonical_ledger(df: DataFrame) -> DataFrame:
    """Rename the ledger headers of one layout to canonical names."""
    found = ledger_columns(df.columns)
    if not found:
        raise ValueError("no narrative column among: " + ", ".join(df.columns))
    taken = set(found.values())
    rest = [F.col(f"`{c}`") for c in df.columns if c not in taken]
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in found.items()], *rest)


def type_ledger(df: DataFrame) -> DataFrame:
    """Dates as timestamps (``None`` where the text is none); columns the feed lacks are null.

    The amount stays as text beside ``valor_sap_numero``, since reports show what
    the export held.
    """
    for c in ("data_entrada_sap", "data_lancamento_sap"):
        day_first = F.contains(F.col(c), F.lit("/")) if c in df.columns else None
        # cells that the sheet does not show as dates arrive as day numbers
        df = df.withColumn(c, F.coalesce(dates.parse_day_number(c), dates.parse_mixed_date(c, day_first))
                           if c in df.columns else F.lit(None).cast("timestamp_ntz"))
    value = F.col("valor_sap") if "valor_sap" in df.columns else F.lit(None).cast("string")
    return df.withColumn("valor_sap", value).withColumn(
        "valor_sap_numero", numbers.try_numeric("valor_sap", numbers.MONEY))


def prepare_antifraud(df: DataFrame, key: str, order: Sequence[Column], prefix: str = "cs_",
                      keep: Sequence[str] = ()) -> DataFrame:
    """Last report row per order, all other columns prefixed."""
    keyed = df.withColumn("vtex_order_id", text.order_key_prefix(key))
    return prefix_columns(first_per_key(keyed, ["vtex_order_id"], order), prefix,
                          keep=("vtex_order_id", *keep))


def try_numeric(df: DataFrame, column: str, to: str = "double") -> DataFrame:
    return df.withColumn(column, numbers.try_numeric(column, to))


def parse_utc(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text timestamps as UTC; columns the frame lacks are skipped."""
    return df.withColumns({c: dates.parse_utc(c) for c in cols if c in df.columns})


def valid_order_ids(df: DataFrame, column: str = "vtex_order_id") -> DataFrame:
    """Distinct order ids that are not blank.

    Rows without one meet in one group per task and are dropped after grouping: a filter
    would be pushed down and evaluate an id parsed from a document again for every row.
    """
    ids = df.select(text.blank_to_null(column).alias("order_id"))
    return ids.groupBy("order_id").agg(F.count("order_id").alias("_rows")).where("_rows > 0").drop("_rows")


def month_range_filter(
    df: DataFrame, start: str | None = None, end: str | None = None, column: str = "record_date"
) -> DataFrame:
    """Rows of the months from ``start`` to ``end``; of a frame stored by month, only their folders."""
    kept = df.where(dates.in_months(column, start, end))
    if STORED_MONTH not in df.columns:
        return kept
    month = F.col(STORED_MONTH)
    bounds = [month.isNotNull(), *([month >= start] if start else []), *([month <= end] if end else [])]
    return kept.where(reduce(lambda a, b: a & b, bounds))


