"""Money and rates.  Amounts stay DECIMAL inside and become DOUBLE at the edge."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyweave.functions.text import _col

MONEY = "decimal(18,2)"


def money(c: Column | str) -> Column:
    return _col(c).cast(MONEY)


def try_numeric(c: Column | str, to: str = "double") -> Column:
    """Bad numbers become null instead of failing the job."""
    return F.trim(_col(c).cast("string")).try_cast(to)


def cents_to_amount(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(0)) / F.lit(100)


def as_double(c: Column) -> Column:
    return c.cast("double")


def total(amount: Column) -> Column:
    """Sum of a money column, zero for no rows."""
    return as_double(F.coalesce(F.sum(money(amount)), F.lit(0)))


def mean_amount(amount: Column) -> Column:
    """Mean of the non-null amounts rounded to cents, zero for no rows."""
    mean = F.round(F.try_divide(F.sum(money(amount)), F.count(amount)), 2)
    return as_double(F.coalesce(mean, F.lit(0)))


def percent(part: Column, whole: Column) -> Column:
    """``part / max(whole, 1) * 100`` with one decimal, in exact arithmetic."""
    ratio = (part * 100).cast("decimal(20,0)") / F.greatest(whole, F.lit(1))
    return as_double(F.round(ratio, 1))
