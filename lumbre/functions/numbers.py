"""Numbers as people write them: symbols, thousands and either decimal mark."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Currency and unit marks that may surround a number.
_MARK = r"(?:[$€£¥₹]|USD|ARS|EUR|BRL|CLP|UYU|MXN)"
_TAIL = r"(?:%|[$€£¥₹]|USD|ARS|EUR)"

_PLAIN_POINT = r"^[+-]?(?:\d{1,3}(?:,\d{3})+|\d*)(?:\.\d+)?$"
_PLAIN_COMMA = r"^[+-]?(?:\d{1,3}(?:\.\d{3})+|\d*)(?:,\d+)?$"


def body(c: Column) -> Column:
    """The digits and marks of the number without its symbols, or NULL."""
    inner = F.regexp_extract(c, rf"^\s*{_MARK}?\s*(.*?)\s*{_TAIL}?\s*$", 1)
    packed = F.regexp_replace(inner, " ", "")
    return F.when(packed.rlike(r"^[+-]?[\d.,]+$") & packed.rlike(r"\d"), packed)


def unit_mark(c: Column) -> Column:
    """The symbol written before or after the number, NULL if none."""
    before = F.regexp_extract(c, rf"^\s*({_MARK})", 1)
    after = F.regexp_extract(c, rf"({_TAIL})\s*$", 1)
    return F.coalesce(F.nullif(before, F.lit("")), F.nullif(after, F.lit("")))


def body_hints_point(b: Column) -> Column:
    """The number can only be read with ``.`` as decimal mark. (``body_…`` functions take the result of ``body``.)"""
    return b.rlike(r"\.\d{1,2}$|\.\d{4,}$|^[+-]*0\.|,\d{3}\.\d")


def body_hints_comma(b: Column) -> Column:
    return b.rlike(r",\d{1,2}$|,\d{4,}$|^[+-]*0,|\.\d{3},\d")


def body_value(b: Column, decimal: str) -> Column:
    """Strict: thousands only group three by three, one decimal mark at most."""
    if decimal == ".":
        return F.when(b.rlike(_PLAIN_POINT), F.translate(b, ",", "").try_cast("double"))
    return F.when(b.rlike(_PLAIN_COMMA), F.translate(F.translate(b, ".", ""), ",", ".").try_cast("double"))


def parse(c: Column, decimal: str = ".") -> Column:
    """The number as double under the column's decimal mark; bad values give NULL."""
    return body_value(body(c), decimal)


def needs_cleaning(c: Column, decimal: str) -> Column:
    clean = r"^[+-]?\d+(\.\d+)?$" if decimal == "." else r"^[+-]?\d+$"
    return ~F.trim(c).rlike(clean)


def strip_marks(c: Column, decimal: str = ".") -> Column:
    """Ingest-time cleaning: drop what is not a digit or the decimal mark, comma to point, cast."""
    if decimal == ",":
        kept = F.translate(F.regexp_replace(c, "[^0-9,-]", ""), ",", ".")
    else:
        kept = F.regexp_replace(c, "[^0-9.-]", "")
    return kept.try_cast("double")


def ns_to_ms(c: Column) -> Column:
    return F.round(c / F.lit(1e6), 1)


def bytes_to_kb(c: Column) -> Column:
    return F.round(c / F.lit(1024.0), 1)
