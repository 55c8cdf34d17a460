"""Feeds whose files only make sense whole: HTML reports and workbooks.

Each file is one row of a ``binaryFile`` scan and is opened by one task, with
the standard library only; the rows it holds go on as ordinary columns.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from datetime import datetime, timedelta
from functools import reduce
from itertools import islice
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tallyweave.session import cut_lineage
from tallyweave.sources.listing import Files

CELLS = "path string, row_no bigint, header array<string>, cells array<string>, problem string"
_COLUMNS = ["path", "row_no", "header", "cells", "problem"]
BATCH_ROWS = 10_000


class Unreadable(ValueError):
    """A file that does not hold what its name says, and why."""


class _FirstTable(HTMLParser):
    """Collects the cell texts of the first table of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.depth = 0
        self.done = False
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if tag == "table":
            self.depth += 1
        elif self.depth == 1 and tag == "tr":
            self._close_cell()
            self.rows.append([])
        elif self.depth == 1 and tag in ("td", "th"):
            self._close_cell()
            self.cell = []

    def handle_endtag(self, tag):
        if self.done or not self.depth:
            return
        if tag == "table":
            self._close_cell()
            self.depth -= 1
            self.done = self.depth == 0
        elif self.depth == 1 and tag in ("td", "th", "tr"):
            self._close_cell()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def _close_cell(self):
        if self.cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None


def html_rows(content: bytes) -> list[list[str]]:
    """Rows of the first table of a page; a page without one has none."""
    try:
        page = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        page = content.decode("latin-1")
    parser = _FirstTable()
    parser.feed(page)
    parser.close()
    return [r for r in parser.rows if r]


# Parts and namespace of a spreadsheet package
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_SHARED = "xl/sharedStrings.xml"
_SHEETS = re.compile(r"xl/worksheets/sheet(\d+)\.xml")


def _column_index(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


# Numbers of the built-in date formats of a spreadsheet, and its first day
_DATE_FORMATS = frozenset({14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47})
_STYLES = "xl/styles.xml"
_FIRST_DAY = datetime(1899, 12, 30)
_QUOTED = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]')


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a date."""
    if _STYLES not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read(_STYLES))
    own = {
        int(f.get("numFmtId")) for f in root.iter(_NS + "numFmt")
        if re.search("[dmyhs]", _QUOTED.sub("", f.get("formatCode", "")).lower())
    }
    formats = root.find(_NS + "cellXfs")
    return set() if formats is None else {
        i for i, f in enumerate(formats.iter(_NS + "xf")) if int(f.get("numFmtId", 0)) in _DATE_FORMATS | own}


def _day(serial: str) -> str:
    """A day number with its part of a day, as ISO text."""
    return str(_FIRST_DAY + timedelta(seconds=round(float(serial) * 86_400)))


def workbook_rows(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet as text, one at a time; cells shown as dates are ISO dates.

    What is held beside the package is a row and the strings that rows share.
    """
    try:
        yield from _workbook_rows(content)
    except (zipfile.BadZipFile, ElementTree.ParseError, LookupError, ValueError, OverflowError) as error:
        raise Unreadable(f"{type(error).__name__}: {error}") from error


def _workbook_rows(content: bytes) -> Iterator[list[str | None]]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        dated = _date_styles(book)
        shared: list[str] = []
        if _SHARED in names:
            root = ElementTree.fromstring(book.read(_SHARED))
            shared = ["".join(t.text or "" for t in si.iter(_NS + "t")) for si in root.iter(_NS + "si")]
        sheets = sorted((n for n in names if _SHEETS.fullmatch(n)),
                        key=lambda n: int(_SHEETS.fullmatch(n).group(1)))
        with book.open(sheets[0]) as sheet:
            above: list = []  # the elements that are open
            for event, row in ElementTree.iterparse(sheet, ("start", "end")):
                if event == "start":
                    above.append(row)
                    continue
                above.pop()
                if row.tag != _NS + "row":
                    continue
                cells: list[str | None] = []
                for c in row.iter(_NS + "c"):
                    at = _column_index(c.get("r", "")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    value = c.find(_NS + "v")
                    if c.get("t") == "s" and value is not None:
                        cells[at] = shared[int(value.text)]
                    elif c.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(_NS + "t"))
                    elif value is not None and c.get("t", "n") == "n" and int(c.get("s", -1)) in dated:
                        cells[at] = _day(value.text)
                    elif value is not None:
                        cells[at] = value.text
                if above:
                    above[-1].clear()  # with the row
                yield cells


def _cells_of(reader: Callable[[bytes], Iterable]):
    """Tasks turn each file into rows that carry their file's header.

    A reader that gives rows one at a time reads its file to its end first, so that
    one that cannot be read adds a single row with the reason and none of its cells.
    A file of no more than a batch of rows beside its header is held meanwhile; a longer one
    is read again for its rows, of which a batch is held.
    """

    def whole(content: bytes) -> Iterable:
        rows = reader(content)
        if not isinstance(rows, Iterator):
            return rows
        held, more = list(islice(rows, BATCH_ROWS + 1)), False
        for _ in rows:
            more = True
        return reader(content) if more else held

    def open_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = enumerate(whole(content))
                except Unreadable as error:
                    yield pd.DataFrame([(path, 0, None, None, str(error))], columns=_COLUMNS)
                    continue
                header = None
                while part := list(islice(rows, BATCH_ROWS)):
                    header = part[0][1] if header is None else header
                    yield pd.DataFrame([(path, i, header, cells, None) for i, cells in part], columns=_COLUMNS)

    return open_files


def read_cells(spark: SparkSession, files: Files | Sequence[str], reader: Callable[[bytes], Iterable]) -> DataFrame:
    """The cells of the files, see :func:`cells_of`; no path passes through the driver."""
    return cells_of(Files.of(files).contents(spark), reader)


def cells_of(files: DataFrame, reader: Callable[[bytes], Iterable]) -> DataFrame:
    """Every file (path, content) opened in one task, its rows stored: :data:`CELLS`.

    Row 0 is the header.  A file that cannot be read has one row with the
    ``problem`` instead; see :func:`problems`.
    """
    return cut_lineage(files.select("path", "content").mapInPandas(_cells_of(reader), CELLS))


def problems(cells: DataFrame) -> DataFrame:
    """The skipped files: path and reason."""
    return cells.where("problem IS NOT NULL").select("path", "problem")


def layouts(cells: DataFrame) -> list[list[str | None]]:
    """The distinct header rows; there are as many as layouts, not files."""
    headers = cells.where("row_no = 0 AND header IS NOT NULL").select("header").distinct()
    return [r["header"] for r in headers.orderBy("header").collect()]


def _tags(source_file: str | None, position: str | None) -> list[Column]:
    tags = []
    if source_file:
        tags.append(F.element_at(F.split("path", "/"), -1).alias(source_file))
    if position:
        tags.append(F.struct(F.col("path").alias("path"), F.lit(0).cast("bigint").alias("block"),
                             F.col("row_no").alias("line")).alias(position))
    return tags


def named_cells(
    cells: DataFrame, rename: Callable[[list[str]], dict[str, str]] | None = None,
    source_file: str | None = None, position: str | None = None,
) -> DataFrame:
    """Cells to named columns, one column per name over all layouts.

    ``rename`` maps the names of one layout (new name to old), so that files
    which call a thing differently still fill one column; a layout for which it
    returns nothing is left out.  The other columns keep their names.
    """
    where: dict[str, list[tuple[list, int]]] = {}
    used, order = [], {}
    for header in layouts(cells):
        names = [n for n in header if n]
        found = rename(names) if rename else {}
        if rename and not found:
            continue
        used.append(header)
        old = {o: new for new, o in found.items()}
        for at, name in enumerate(header):
            if name and header.index(name) == at:
                new = old.get(name, name)
                where.setdefault(new, []).append((header, at))
                order[new] = min(order.get(new, at), at)
    if not used:
        return cells.sparkSession.createDataFrame([], T.StructType([]))

    def is_layout(header: list) -> Column:
        return F.col("header") == F.array(*[F.lit(h) for h in header])

    def value(name: str) -> Column:
        spots: dict[int, list] = {}
        for header, at in where[name]:
            spots.setdefault(at, []).append(header)
        if len(spots) == 1 and len(where[name]) == len(used):
            cell = F.get("cells", F.lit(next(iter(spots))))
        else:
            chosen = F
            for at, headers in spots.items():
                test = reduce(lambda a, b: a | b, map(is_layout, headers))
                chosen = chosen.when(test, F.get("cells", F.lit(at)))
            cell = chosen
        return F.nullif(cell, F.lit("")).alias(name)

    rows = cells.where("row_no > 0 AND problem IS NULL")
    if rename:
        rows = rows.where(reduce(lambda a, b: a | b, map(is_layout, used)))
    return rows.select(*[value(n) for n in sorted(order, key=lambda n: (order[n], n))],
                       *_tags(source_file, position))


def _scan(
    spark: SparkSession, files: Files | Sequence[str] | None, reader: Callable[[bytes], Iterable],
    source_file: str | None, position: str | None,
) -> DataFrame:
    if not files:
        return spark.createDataFrame([], T.StructType([]))
    return named_cells(read_cells(spark, files, reader), None, source_file, position)


def with_tables(spark: SparkSession, files: Files | None) -> Files | None:
    """The files that have the tag of a table in a line; ``None`` where none has.

    Only these can give rows as pages.  A large file of plain text under the name of a page
    is passed over line by line here, by as many tasks as it has blocks, and never held whole.
    Where all files are alike the folder stays one; otherwise the paths of the pages are named.
    """
    if not files:
        return None
    value = F.col("value")
    tagged = F.contains(value, F.lit("<")) & F.contains(F.lower(value), F.lit("<table"))
    lines = files.reader(spark).text(files.source).where(files.kept())
    found = cut_lineage(lines.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.bool_or(tagged).alias("page")))
    pages, others = found.agg(F.count_if("page"), F.count_if(~F.col("page"))).first()
    if not pages:
        return None
    return Files(sorted(r["path"] for r in found.where("page").collect())) if others else files


def scan_html_tables(
    spark: SparkSession, files: Files | Sequence[str] | None, source_file: str | None = None,
    position: str | None = None,
) -> DataFrame:
    """First table of each HTML file (reports saved as ``.xls``)."""
    return _scan(spark, files, html_rows, source_file, position)


def scan_workbooks(
    spark: SparkSession, files: Files | Sequence[str] | None, source_file: str | None = None,
    position: str | None = None,
) -> DataFrame:
    """First sheet of each ``.xlsx`` file; unreadable files are left out whole."""
    return _scan(spark, files, workbook_rows, source_file, position)
