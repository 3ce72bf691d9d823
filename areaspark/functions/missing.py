"""Missing-value rules.

Spark aggregates skip NULL; the survey rules here are *strict*: one missing
estimate makes the total missing. Every helper is a plain Column expression, so
it stays inside whole-stage codegen and keeps map-side partial aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _strict(col: Column | str, agg: Callable[[Column], Column]) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.count(c) == F.count(F.lit(1)), agg(c))


def sum_strict(col: Column | str) -> Column:
    return _strict(col, F.sum)


def min_strict(col: Column | str) -> Column:
    return _strict(col, F.min)


def max_strict(col: Column | str) -> Column:
    return _strict(col, F.max)


def mean_strict(col: Column | str) -> Column:
    return _strict(col, F.avg)


def stddev_strict(col: Column | str) -> Column:
    return _strict(col, F.stddev_samp)


def sum_strict_where(condition: Column, col: Column | str) -> Column:
    """Strict sum of the rows that meet ``condition``; NULL when none does.

    Lets many categories be totalled in one aggregate, which replaces
    filter -> group -> pivot (two shuffles) by one shuffle.
    """
    c = F.col(col) if isinstance(col, str) else col
    unknown = F.count(F.when(condition & c.isNull(), F.lit(1)))
    return F.when(unknown == 0, F.sum(F.when(condition, c)))


def if_else(condition: Column, yes, no) -> Column:
    """Two-way choice in which a NULL condition gives NULL."""
    return F.when(condition.isNull(), F.lit(None)).when(condition, yes).otherwise(no)


def is_in(col: Column | str, values: Iterable) -> Column:
    """Membership that is never NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.isin(list(values)), F.lit(False))


def not_in(col: Column | str, values: Iterable) -> Column:
    """Negated membership; a NULL value is not a member and is kept."""
    return ~is_in(col, values)


def is_missing(col: Column | str) -> Column:
    """NULL or NaN, for double columns that may hold either."""
    c = F.col(col) if isinstance(col, str) else col
    return c.isNull() | F.isnan(c)


def finite_or_null(col: Column | str) -> Column:
    """Infinite and NaN values become NULL."""
    c = F.col(col) if isinstance(col, str) else col
    inf = F.lit(float("inf"))
    return F.when(F.isnan(c) | (F.abs(c) == inf), F.lit(None)).otherwise(c)


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Division that gives NULL, never an error or an infinity, on zero."""
    n = F.col(numerator) if isinstance(numerator, str) else numerator
    d = F.col(denominator) if isinstance(denominator, str) else denominator
    return F.try_divide(n, d)
