"""Timestamps, months and month ranges."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

from tallyweave import constants as C
from tallyweave.functions.text import _col

# Date layouts met in the feeds, tried in order.
ISO_LAYOUTS = (
    "yyyy-M-d", "yyyy-M-d H:m", "yyyy-M-d H:m:s", "yyyy-M-d H:m:s[.SSSSSS][.SSS]",
    "yyyy-M-d'T'H:m", "yyyy-M-d'T'H:m:s",
)
NAMED_LAYOUTS = ("d MMM yyyy", "d MMM yyyy H:m:s", "d MMMM yyyy", "MMM d yyyy", "MMMM d yyyy")

# day and month in either order, year, and an optional time with an optional half of the day
_NUMBERS = (r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})"
            r"(?:[ T]+(\d{1,2}):(\d{1,2})(?::(\d{1,2})(\.\d+)?)?\s*([AaPp][Mm])?)?$")
#: The same without a time and with the year in full, as most cells of such columns are.
_DAY = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$"
#: Two-digit years from this one on belong to the last century.
CENTURY_TURN = 69


def _first_parse(value: Column, layouts: tuple[str, ...]) -> Column:
    tries = [F.try_to_timestamp(value, F.lit(x)) for x in layouts]
    return F.coalesce(*tries).cast("timestamp_ntz")


def _from_numbers(value: Column, day_first: Column) -> Column:
    """``31/1/2025 10:05 PM`` and the like, put together as ISO text and parsed once per order."""
    def part(i: int) -> Column:
        return F.regexp_extract(value, _NUMBERS, i)

    def or_zero(i: int) -> Column:
        return F.coalesce(F.nullif(part(i), F.lit("")), F.lit("0"))

    short = part(3).try_cast("int") + F.when(part(3).try_cast("int") < CENTURY_TURN, 2000).otherwise(1900)
    year = F.when(F.length(part(3)) == 2, short.cast("string")).otherwise(part(3))
    half, hour = F.lower(part(8)), or_zero(4).try_cast("int")
    hours = F.when((half == "pm") & (hour < 12), hour + 12).when((half == "am") & (hour == 12), 0).otherwise(hour)
    clock = F.concat(F.lit(" "), hours.cast("string"), F.lit(":"), or_zero(5), F.lit(":"), or_zero(6), part(7))

    def ordered(month: int, day: int) -> Column:
        return F.concat(year, F.lit("-"), part(month), F.lit("-"), part(day), clock).try_cast("timestamp_ntz")

    return F.when(day_first, F.coalesce(ordered(2, 1), ordered(1, 2))).otherwise(
        F.coalesce(ordered(1, 2), ordered(2, 1)))


def _from_day(value: Column, day_first: Column) -> Column:
    """``31/1/2025``, turned round by one replacement per order."""
    def ordered(iso: str) -> Column:
        return F.regexp_replace(value, _DAY, iso).try_cast("timestamp_ntz")

    by_day, by_month = ordered("$3-$2-$1"), ordered("$3-$1-$2")
    return F.when(day_first, F.coalesce(by_day, by_month)).otherwise(F.coalesce(by_month, by_day))


def parse_mixed_date(c: Column | str, day_first: Column) -> Column:
    """Parse one text date; ``day_first`` says which convention its file uses.

    ISO text (with ``-`` or ``/``), eight digits and named months read the same
    under both conventions.  For numbers the preferred order is tried first and
    the other only where that is impossible (as ``13`` for a month).  Anything
    else is null.  Each kind is told by its shape, so a cell is parsed by its
    own layouts only.
    """
    value = F.trim(_col(c))
    dashed = F.replace(value, F.lit("/"), F.lit("-"))
    iso = F.coalesce(dashed.try_cast("timestamp_ntz"), _first_parse(dashed, ISO_LAYOUTS))
    named = F.initcap(F.regexp_replace(value, "[-,. ]+", " "))
    return (
        F.when(value.rlike(r"^\d{4}[-/]"), iso)
        .when(value.rlike(_DAY), _from_day(value, day_first))
        .when(value.rlike(_NUMBERS), _from_numbers(value, day_first))
        .when(value.rlike(r"^\d{8}$"), _first_parse(value, ("yyyyMMdd",)))
        .when(value.rlike(r"^(\d{1,2}[- ]+)?[A-Za-z]{3,9}[-,. ]"), _first_parse(named, NAMED_LAYOUTS))
    )


def parse_day_number(c: Column | str) -> Column:
    """A spreadsheet's day number (days from 1899-12-30, with a part of a day) as a timestamp."""
    number = F.regexp_extract(F.trim(_col(c)), r"^\d{5}(\.\d+)?$", 0).try_cast("double")
    seconds = F.round(number * 86400).cast("decimal(18,6)")
    return F.expr("TIMESTAMP_NTZ '1899-12-30 00:00:00'") + F.make_dt_interval(secs=seconds)


def parse_utc(c: Column | str) -> Column:
    """ISO text with or without an offset, as UTC wall-clock time; bad text is null."""
    instant = _col(c).try_cast("timestamp")
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def month_key(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM")


def month_label(month: Column | str) -> Column:
    """``2025-01`` as ``Jan/25``."""
    value = _col(month)
    names = F.array(*[F.lit(m) for m in C.MONTH_NAMES])
    number = F.substring(value, 6, 2).try_cast("int")
    return F.concat(F.try_element_at(names, number), F.lit("/"), F.substring(value, 3, 2))


def month_bounds(start: str | None, end: str | None) -> tuple[datetime | None, datetime | None]:
    """Inclusive ``YYYY-MM`` months as a half-open pair of instants."""
    low = datetime.strptime(start, "%Y-%m") if start else None
    high = None
    if end:
        last = datetime.strptime(end, "%Y-%m")
        high = last.replace(year=last.year + last.month // 12, month=last.month % 12 + 1)
    return low, high


def in_months(c: Column | str, start: str | None = None, end: str | None = None) -> Column:
    """Range test on the bare column, so that the scan can skip row groups."""
    value = _col(c)
    low, high = month_bounds(start, end)
    test = value.isNotNull()
    if low is not None:
        test = test & (value >= F.lit(low.strftime("%Y-%m-%d")).cast("timestamp_ntz"))
    if high is not None:
        test = test & (value < F.lit(high.strftime("%Y-%m-%d")).cast("timestamp_ntz"))
    return test
