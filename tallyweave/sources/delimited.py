"""Folders of delimited text whose files differ in delimiter, columns and encoding.

One pass over the lines tells how each file is to be read: its header line, whether
it is valid UTF-8, whether quoted values hold line breaks, and which of the wanted
columns hold a slash, which decides how their dates are read.  Files that agree in all
of that are read together by Spark's CSV reader, and the groups are stacked by column
name; there are as many groups as there are layouts and conventions, not files.  So a
file is read twice, and nothing is joined by file.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tallyweave.operators.feeds import union_by_name
from tallyweave.sources.listing import Files, with_source_file

DELIMITERS = (",", ";", "\t", "|")
BOM = "﻿"
LATIN1 = "ISO-8859-1"


@dataclass(frozen=True)
class Layout:
    header: str
    delimiter: str
    encoding: str = "UTF-8"
    #: a quoted value may hold a line break, so files are not split
    multi_line: bool = False
    #: the wanted columns with a slash somewhere in the file
    slashed: frozenset[str] = frozenset()

    @property
    def columns(self) -> list[str]:
        """Header names, unquoted; empty or repeated names get a position suffix."""
        names: list[str] = []
        for i, raw in enumerate(_split_quoted(self.header, self.delimiter)):
            name = raw.strip().strip('"').lstrip(BOM)
            names.append(name if name and name not in names else f"{name or 'column'}_{i}")
        return names


def _split_quoted(line: str, delimiter: str) -> list[str]:
    parts, current, quoted = [], "", False
    for ch in line:
        if ch == '"':
            quoted = not quoted
        if ch == delimiter and not quoted:
            parts.append(current)
            current = ""
        else:
            current += ch
    return [*parts, current]


def sniff_delimiter(header: str, delimiters: Sequence[str] = DELIMITERS) -> str:
    """The delimiter that cuts the header into most fields; comma when none does."""
    return max(delimiters, key=lambda d: len(_split_quoted(header, d)))


#: Columns whose slashes the pass over the lines can note; bits of a whole number.
NOTED = 63
#: A quote within an unquoted value, which the pass over the lines cannot follow.
_STRAY_QUOTE = r'[^,;\t|"]"[^,;\t|"]'

_FILE = ("path string, header binary, delimiter string, encoding string, open boolean, "
         "slashed array<string>, unsure boolean")


def _count(value: Column, text: str) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit(text), F.lit("")))


def _marks(value: Column) -> Column:
    """The delimiters and slashes of a line up to its last slash, which is left out; null without any.

    Delimiters between quotes separate nothing.  What stands there is left out whole,
    part by part only where it holds a slash.
    """
    between = F.transform(F.split(value, '"'), lambda part, i: F.when(
        i % 2 == 1, F.regexp_replace(part, "[^/]+", "")).otherwise(part))
    unquoted = F.regexp_replace(value, '"[^"]*("|$)', "")
    plain = F.when(~F.contains(value, F.lit('"')), value).when(
        _count(unquoted, "/") == _count(value, "/"), unquoted).otherwise(F.array_join(between, ""))
    return F.when(F.contains(value, F.lit("/")), F.regexp_replace(plain, r"/[^/]*$|[^/,;\t|]+", ""))


def _slashes(marks: Column, delimiter: str) -> Column:
    """Bit i is set when field i holds a slash: the delimiters before a slash tell its field."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def step(so_far: Column, part: Column) -> Column:
        field = so_far["field"] + _count(part, delimiter)
        bit = F.when(field < NOTED, F.call_function("shiftleft", one, field)).otherwise(zero)
        return F.struct(field.alias("field"), so_far["bits"].bitwiseOR(bit).alias("bits"))

    noted = F.aggregate(F.split(marks, "/"), F.struct(F.lit(0).alias("field"), zero.alias("bits")), step, lambda end: end["bits"])
    return F.when(marks.isNull(), zero).when(F.contains(marks, F.lit(delimiter)), noted).otherwise(one)


def _profiles(
    spark: SparkSession, files: Files, delimiter: str | None, detect_encoding: bool, wanted: Sequence[str],
    must_have: str | None,
) -> DataFrame:
    """A row per file (:data:`_FILE`), from one pass over the lines.

    Files without the ``must_have`` column are left out here, so that what stands in
    their first line (a whole page, perhaps) never leaves its task.
    """
    tried = [delimiter] if delimiter else list(DELIMITERS)
    value = F.col("raw").cast("string")
    quotes = _count(value, '"')
    lines = files.reader(spark).text(files.source).where(files.kept()).select(
        F.col("_metadata.file_path").alias("path"),
        F.struct(F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("line")).alias("position"),
        F.col("value").cast("binary").alias("raw"),
        *([_marks(F.col("value")).alias("marks")] if wanted else []),
    )
    found = lines.groupBy("path").agg(
        F.min_by("raw", "position").alias("header"),
        (F.bool_and(F.is_valid_utf8(value)) if detect_encoding else F.lit(True)).alias("utf8"),
        F.bool_or(quotes % 2 == 1).alias("open"),
        (F.bool_or(F.contains(value, F.lit('"')) & value.rlike(_STRAY_QUOTE)) if wanted else F.lit(False)).alias("stray"),
        *(F.bit_or(_slashes(F.col("marks"), d)).alias(f"bits{i}") for i, d in enumerate(tried) if wanted),
    )

    def describe(parts):
        """A handful of values per file; no line of it."""
        for part in parts:
            rows = []
            for file in part.itertuples(index=False):
                encoding = "UTF-8" if file.utf8 else LATIN1
                header = bytes(file.header).decode(encoding, errors="replace").lstrip(BOM)
                used = delimiter or sniff_delimiter(header)
                columns = Layout(header, used).columns
                if must_have is not None and must_have not in columns:
                    continue
                slashed, unsure = [], False
                if wanted:
                    bits = int(getattr(file, f"bits{tried.index(used)}"))
                    places = {c: columns.index(c) for c in wanted if c in columns}
                    slashed = [c for c, i in places.items() if i < NOTED and bits >> i & 1]
                    unsure = bool(places) and (file.open or file.stray or max(places.values()) >= NOTED)
                rows.append((file.path, file.header, used, encoding, file.open, slashed, unsure))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in _FILE.split(", ")])

    return found.mapInPandas(describe, _FILE)


def read_layouts(
    spark: SparkSession, files: Files | Sequence[str], delimiter: str | None = None,
    detect_encoding: bool = False, wanted: Sequence[str] = (), must_have: str | None = None,
) -> dict[Layout, Files]:
    """Group files by layout, and by which of the ``wanted`` columns hold a slash.

    Where all files of a folder agree, the folder is read as such and no path is
    named; otherwise each group names its files.  Quoted line breaks and stray quotes
    are beyond the pass over the lines; such files are parsed once more for their slashes.
    An absent folder, and one without a line, has no layouts.
    """
    files = Files.of(files)
    try:
        profiles = _profiles(spark, files, delimiter, detect_encoding, wanted, must_have)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    kind = ["header", "delimiter", "encoding", "open", "slashed", "unsure"]
    found = profiles.groupBy(*kind).agg(
        F.sort_array(F.collect_list("path")).alias("paths")).collect()
    layouts: dict[Layout, list[str]] = defaultdict(list)
    for row in sorted(found, key=lambda r: r["paths"][0]):
        header = bytes(row["header"]).decode(row["encoding"], errors="replace").lstrip(BOM)
        layout = Layout(header, row["delimiter"], row["encoding"], row["open"], frozenset(row["slashed"]))
        if row["unsure"]:
            for slashed, paths in _parsed_slashes(spark, layout, row["paths"], wanted):
                layouts[replace(layout, slashed=slashed)] += paths
        else:
            layouts[layout] += row["paths"]
    if len(layouts) == 1 and must_have is None:
        return {layout: files for layout in layouts}
    return {layout: Files(sorted(paths)) for layout, paths in layouts.items()}


def _parsed_slashes(
    spark: SparkSession, layout: Layout, paths: list[str], wanted: Sequence[str],
) -> list[tuple[frozenset[str], list[str]]]:
    columns = [c for c in wanted if c in layout.columns]
    rows = _read(spark, layout, Files(paths), False)
    flags = rows.select(F.col("_metadata.file_path").alias("path"), *columns).groupBy("path").agg(
        F.array_compact(F.array(*(F.when(F.max(F.contains(F.col(c), F.lit("/"))), F.lit(c)) for c in columns))).alias("slashed"))
    grouped = flags.groupBy("slashed").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()
    held = {p for g in grouped for p in g["paths"]}  # files without a row hold no slash
    return [(frozenset(g["slashed"]), g["paths"]) for g in grouped] + [(frozenset(), [p for p in paths if p not in held])]


def _read(spark: SparkSession, layout: Layout, files: Files, multi_line: bool) -> DataFrame:
    text = T.StringType()
    fields = [T.StructField(c, text) for c in layout.columns] + [T.StructField("_malformed", text)]
    return (
        files.reader(spark).schema(T.StructType(fields))
        .option("header", "true").option("sep", layout.delimiter)
        .option("encoding", layout.encoding).option("quote", '"').option("escape", '"')
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_malformed")
        .option("enforceSchema", "true").option("ignoreCorruptFiles", "true")
        .option("multiLine", str(multi_line or layout.multi_line).lower())
        .csv(files.source).where(files.kept())
    )


def _field_count(line: Column, delimiter: str) -> Column:
    unquoted = F.regexp_replace(line, '"[^"]*"', "")
    return F.length(unquoted) - F.length(F.replace(unquoted, F.lit(delimiter), F.lit(""))) + 1


#: What is done to the rows of one layout before they are stacked.
Shape = Callable[[DataFrame, Layout], DataFrame]


def scan_delimited(
    spark: SparkSession, folder: str, pattern: str = "*.csv", source_file: str | None = None,
    position: str | None = None, multi_line: bool = False, required: bool = True,
) -> DataFrame:
    """All files of a folder, each with its own delimiter, stacked by column name.

    Values are text.  ``source_file`` and ``position`` name columns for the
    file name and the load order (see :func:`_tagged`).
    """
    rows = read_delimited(spark, Files.matching(folder, pattern), source_file, position, multi_line)
    if required and not rows.columns:
        raise FileNotFoundError(f"no {pattern} with a line in {folder}")
    return rows


def read_delimited(
    spark: SparkSession, files: Files | Sequence[str], source_file: str | None = None,
    position: str | None = None, multi_line: bool = False, wanted: Sequence[str] = (),
    shape: Shape | None = None,
) -> DataFrame:
    """As :func:`scan_delimited`; ``shape`` sees each layout, with the slashes of ``wanted`` columns."""
    frames = [
        _shaped(_tagged(_read(spark, layout, group, multi_line), source_file, position).drop("_malformed"), layout, shape)
        for layout, group in read_layouts(spark, files, wanted=wanted).items()
    ]
    return union_by_name(frames) if frames else spark.createDataFrame([], T.StructType([]))


def _shaped(rows: DataFrame, layout: Layout, shape: Shape | None) -> DataFrame:
    return shape(rows, layout) if shape else rows


def scan_semicolon(
    spark: SparkSession, folder: str, *patterns: str, source_file: str | None = None,
    position: str | None = None, multi_line: bool = False, required: bool = False,
    must_have: str | None = None,
) -> DataFrame:
    """``;`` files in UTF-8 (with or without mark) or Latin-1.

    Rows with too many fields are skipped, rows with too few are padded with
    nulls.  Files without the ``must_have`` column are left out.
    """
    patterns = patterns or ("*.csv",)
    rows = read_semicolon(spark, Files.matching(folder, *patterns), source_file, position, multi_line, must_have)
    if required and not rows.columns:
        raise FileNotFoundError(f"no {' or '.join(patterns)} with a line in {folder}")
    return rows


def read_semicolon(
    spark: SparkSession, files: Files | Sequence[str], source_file: str | None = None,
    position: str | None = None, multi_line: bool = False, must_have: str | None = None,
) -> DataFrame:
    frames = []
    for layout, group in read_layouts(spark, files, ";", detect_encoding=True, must_have=must_have).items():
        rows = _read(spark, layout, group, multi_line)
        fits = F.col("_malformed").isNull() | (
            _field_count(F.col("_malformed"), ";") <= len(layout.columns)
        )
        frames.append(_tagged(rows, source_file, position).where(fits).drop("_malformed"))
    if not frames:
        return spark.createDataFrame([], T.StructType([]))
    return union_by_name(frames)


def _tagged(df: DataFrame, source_file: str | None, position: str | None) -> DataFrame:
    """Add the file name and a struct that sorts rows by path, then place in the file."""
    if position:
        place = F.struct(F.col("_metadata.file_path").alias("path"),
                         F.col("_metadata.file_block_start").alias("block"),
                         F.monotonically_increasing_id().alias("line"))
        df = df.withColumn(position, place)
    return with_source_file(df, source_file) if source_file else df
