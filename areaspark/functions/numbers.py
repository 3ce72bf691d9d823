"""Number parsing and display expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_number(col: Column | str) -> Column:
    """First number inside a text, grouping commas dropped; NULL when there is none."""
    digits = F.regexp_extract(_c(col), r"-?\d[\d,]*\.?\d*", 0)
    return F.regexp_replace(digits, ",", "").try_cast("double")


def number_text(col: Column | str) -> Column:
    """Number as text, whole numbers without a fraction."""
    c = _c(col)
    whole = c.cast("long")
    return F.when(c == whole, whole.cast("string")).otherwise(c.cast("string"))


def half_even(col: Column | str, places: int = 0) -> Column:
    return F.bround(_c(col), places)


def truncate_int(col: Column | str) -> Column:
    return _c(col).cast("long")


def thousands(col: Column | str, prefix: str = "") -> Column:
    """``12,345`` with an optional prefix such as a currency sign."""
    return F.concat(F.lit(prefix), F.format_number(_c(col), 0))


def percent_text(col: Column | str, places: int = 1) -> Column:
    """``12.3%``; a whole percentage is written without a fraction."""
    return F.concat(number_text(F.bround(_c(col) * 100, places)), F.lit("%"))
