"""The three feeds from their folders, ready for matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave import constants as C
from tallyweave.functions import dates, numbers
from tallyweave.operators import feeds
from tallyweave.sources.delimited import Layout, read_delimited, read_semicolon
from tallyweave.sources.documents import named_cells, read_cells, scan_html_tables, with_tables, workbook_rows
from tallyweave.sources.listing import Files


def load_disputes(spark: SparkSession, folder: str) -> DataFrame:
    """Dispute records of both types with parsed dates, amount and order id.

    The files are read twice: for their layouts and date conventions, and for their rows.
    """
    return disputes_of_files(spark, Files.matching(folder, "*.csv"))


def disputes_of_files(spark: SparkSession, files: Files | Sequence[str]) -> DataFrame:
    """As :func:`load_disputes`; ``dispute_id`` is the place a row was read from.

    Files of one date convention are read together, so it is a literal of their rows.
    """
    def dated(rows: DataFrame, layout: Layout) -> DataFrame:
        names = {old: new for old, new in C.DISPUTE_HEADERS.items() if old in rows.columns}
        day_first = {names.get(c, c) for c in layout.slashed}
        return rows.withColumnsRenamed(names).withColumns({
            c: dates.parse_mixed_date(c, F.lit(c in day_first))
            for c in C.DISPUTE_DATES if c in {names.get(x, x) for x in rows.columns}})

    headers = [old for old, new in C.DISPUTE_HEADERS.items() if new in C.DISPUTE_DATES]
    raw = read_delimited(spark, files, source_file="source_file", position="dispute_id",
                         wanted=[*headers, *C.DISPUTE_DATES], shape=dated)
    if not raw.columns:
        raise FileNotFoundError("no dispute file with a line")
    typed = raw.withColumn("dispute_amount", numbers.try_numeric("dispute_amount", numbers.MONEY))
    return feeds.prepare_disputes(typed)


def load_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Chargeback postings of all workbooks, in load order by ``ordinal``.

    The columns are found in each layout by itself, then stacked.  Workbooks
    that cannot be read and those without a narrative column are left out whole.
    """
    files = Files.under(spark, folder, "*.xlsx")
    return ledger_of_cells(read_cells(spark, files, workbook_rows))


def ledger_of_cells(cells: DataFrame) -> DataFrame:
    """As :func:`load_ledger`, from workbooks that are already parsed."""
    raw = named_cells(cells, feeds.ledger_columns, source_file="source_file", position="ordinal")
    if not raw.columns:
        raise ValueError("no workbook has a narrative column")
    return feeds.prepare_ledger(feeds.type_ledger(raw))


def load_antifraud(spark: SparkSession, folder: str, prefix: str = "cs_") -> DataFrame | None:
    """Last report row per order, its columns prefixed; ``None`` without any report.

    A report is an HTML table saved as ``.xls`` or ``;`` text.  ``.xls`` files
    come before ``.csv`` files in load order.
    """
    pages = with_tables(spark, Files.under(spark, folder, "*.xls", required=False))
    html = scan_html_tables(spark, pages, source_file="source_file_cs", position="ordinal")
    frames = []
    if "PEDIDO" in html.columns:
        html = html.where("PEDIDO IS NOT NULL")
        frames.append(html)
    # markup has no header with the order column, so pages are no ``;`` files
    rest = Files.matching(folder, "*.xls", "*.csv")
    text = read_semicolon(spark, rest, source_file="source_file_cs", position="ordinal",
                          must_have="PEDIDO")
    if text.columns:
        frames.append(text)
    if not frames:
        return None
    late = F.when(F.lower("source_file_cs").endswith(".csv"), 1).otherwise(0)
    placed = feeds.union_by_name(frames).withColumn("ordinal", F.struct(late, "ordinal"))
    prepared = feeds.prepare_antifraud(placed, "PEDIDO", [F.desc("ordinal")],
                                       prefix=prefix, keep=("ordinal", "source_file_cs"))
    return prepared.drop("ordinal")
