"""Dates, numbers, digests, JSON, arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Italian names of the months.
MONTHS = ["gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre"]


def date_label(d: Column) -> Column:
    """X1: "12 maggio 2026"; empty for null."""
    name = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(d))
    return F.coalesce(F.concat(F.day(d), F.lit(" "), name, F.lit(" "), F.year(d)), F.lit(""))


def iso_day(t: Column) -> Column:
    """Yyyy-MM-dd of a date or time (session zone UTC)."""
    return F.date_format(t, "yyyy-MM-dd")


def current_year() -> Column:
    """X4."""
    return F.year(F.current_date())


def leading_int(x: Column) -> Column:
    """The integer a text begins with, null if it begins with none or with one beyond 32 bits."""
    return F.regexp_extract(x, r"^\s*([+-]?[0-9]+)", 1).try_cast("int")


def clamped(x: Column, low: Column, high: Column) -> Column:
    """X29."""
    return F.least(F.greatest(x, low), high)


def half_up(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5)


def digest(content: Column, length: int = 8) -> Column:
    """The first hex digits of the md5."""
    return F.substring(F.md5(content), 1, length)


def versioned(x: Column, href: str, version: Column) -> Column:
    """``href`` in a double-quoted attribute gets ``?v=version``, an older one gives way."""
    return F.regexp_replace(x, F.lit(rf'(href="\Q{href}\E)(?:\?v=[0-9a-f]+)?(")'), F.concat(F.lit("$1?v="), version, F.lit("$2")))


def parsed(x: Column, schema: str) -> Column:
    """A JSON text; null where it is none."""
    return F.from_json(x, schema, {"mode": "PERMISSIVE"})


def last_kept(stack: Column, n: int) -> Column:
    """L1: the last n entries of an array."""
    return F.when(F.size(stack) > n, F.slice(stack, -n, n)).otherwise(stack)
