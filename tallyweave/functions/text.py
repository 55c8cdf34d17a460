"""Keys, labels and keyword classes taken from text columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tallyweave import constants as C


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(_col(c)), F.lit(""))


def present(c: Column | str) -> Column:
    """Dashboard notion of a value: ``''`` and the text ``'nan'`` count as missing."""
    value = _col(c)
    return F.when(~value.isin("", "nan"), value)


def order_id_from_metadata(metadata: Column | str) -> Column:
    """``orderId`` of a JSON object; null for bad JSON and for anything but an object."""
    return F.get_json_object(_col(metadata), "$.orderId")


def mentions(c: Column | str, text: str = C.NARRATIVE_TEXT) -> Column:
    """Case-insensitive containment; a null text does not contain anything."""
    return F.coalesce(F.contains(F.upper(_col(c)), F.lit(text.upper())), F.lit(False))


def psp_reference(narrative: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(narrative), C.PSP_PATTERN, 1), F.lit(""))


def nsu_suffix(narrative: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(narrative), C.NSU_PATTERN, 1), F.lit(""))


def order_key_prefix(c: Column | str) -> Column:
    """Text before the first dash, trimmed."""
    return F.trim(F.substring_index(_col(c), "-", 1))


_SUFFIXED = "^([^-]+)(" + "|".join(s for s in C.CANDIDATE_SUFFIXES if s) + ")$"


def dashed(c: Column | str) -> Column:
    return F.contains(_col(c), F.lit("-"))


def base_order_id(c: Column | str) -> Column:
    """The id without a candidate suffix; ids of other forms are their own base."""
    value = _col(c)
    return F.when(dashed(value), F.regexp_replace(value, _SUFFIXED, "$1")).otherwise(value)


def order_id_suffix(c: Column | str) -> Column:
    """The candidate suffix, empty for ids of other forms."""
    value = _col(c)
    found = F.when(dashed(value), F.regexp_extract(value, _SUFFIXED, 2))
    return found.otherwise(F.when(value.isNotNull(), ""))


def upper_method(c: Column | str) -> Column:
    """A payment method as the dashboard groups it: upper-cased, missing ones null."""
    return F.upper(present(c))


def truncate_label(c: Column | str, width: int = C.LABEL_WIDTH) -> Column:
    return F.substring(_col(c), 1, width)


def _any_word(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def classify_delivery(c: Column | str) -> Column:
    """Pipeline classes: pickup, home, null for blank text, otherwise the text itself."""
    value = _col(c)
    lowered = F.lower(value)
    return (
        F.when(_any_word(lowered, C.PICKUP_WORDS), F.lit(C.PICKUP))
        .when(_any_word(lowered, C.HOME_WORDS), F.lit(C.HOME))
        .when((F.trim(lowered) != "") & (lowered != "nan"), value)
    )


def classify_delivery_dash(c: Column | str) -> Column:
    """Dashboard classes: shorter keyword lists, everything else is "other"."""
    value = present(c)
    lowered = F.lower(value)
    return (
        F.when(_any_word(lowered, C.DASH_PICKUP_WORDS), F.lit(C.PICKUP))
        .when(_any_word(lowered, C.DASH_HOME_WORDS), F.lit(C.HOME))
        .when(value.isNotNull(), F.lit(C.OTHER))
    )


def provenance(has_ledger: Column, has_antifraud: Column) -> Column:
    return F.concat_ws(
        C.SOURCE_SEPARATOR,
        F.lit(C.SOURCE_ACQUIRER),
        F.when(has_ledger, F.lit(C.SOURCE_LEDGER)),
        F.when(has_antifraud, F.lit(C.SOURCE_ANTIFRAUD)),
    )


def split_categories(c: Column | str) -> Column:
    """Parts between pipes, trimmed, blanks dropped; an array to explode."""
    parts = F.transform(F.split(_col(c), r"\|"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")
