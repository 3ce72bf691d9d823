"""Wide/long reshaping, stacking and roll-ups."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaspark.functions import missing


def widen(
    df: DataFrame,
    ids: Sequence[str],
    names_from: str,
    values_from: str,
    values: Sequence[str],
    prefix: str = "",
    fill=None,
) -> DataFrame:
    """Long to wide for a known list of names, in one aggregation.

    A cell met twice is an error: keeping either value would hide it.
    """
    cells = []
    for v in values:
        here = F.col(names_from) == v
        n = F.count(F.when(here, F.lit(1)))
        cell = F.when(
            n > 1, F.raise_error(F.lit(f"more than one row for {names_from}={v}")).cast(
                df.schema[values_from].dataType
            )
        ).otherwise(F.max(F.when(here, F.col(values_from))))
        if fill is not None:
            cell = F.coalesce(cell, F.lit(fill))
        cells.append(cell.alias(prefix + v))
    return df.groupBy(*ids).agg(*cells)


def widen_sums(
    df: DataFrame,
    ids: Sequence[str],
    categories: Mapping[str, Column],
    value: str,
    strict: bool = True,
) -> DataFrame:
    """One summed column per category condition, all in one aggregation."""
    if strict:
        cols = [missing.sum_strict_where(c, value).alias(n) for n, c in categories.items()]
    else:
        cols = [F.sum(F.when(c, F.col(value))).alias(n) for n, c in categories.items()]
    return df.groupBy(*ids).agg(*cols)


def lengthen(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value"
) -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def across(
    df: DataFrame, columns: Sequence[str], fn: Callable[[Column], Column]
) -> DataFrame:
    """The same expression on many columns, in one projection."""
    return df.withColumns({c: fn(F.col(c)) for c in columns})


def staged(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns as a stage of their own.

    Later expressions and filters then refer to the values. Without the stage the
    optimizer writes every formula out again wherever its result is used, and a
    chain of parsing steps grows exponentially.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))


def columns_between(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` in column order."""
    cols = df.columns
    return cols[cols.index(first) : cols.index(last) + 1]


def columns_like(df: DataFrame, starts: str = "", ends: str = "") -> list[str]:
    return [c for c in df.columns if c.startswith(starts) and c.endswith(ends)]


def stack(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, matched by name; differing column sets are an error."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def rollup_labelled(
    df: DataFrame, hierarchy: Sequence[str], measures: Sequence[str], label: str = "All", strict: bool = True
) -> DataFrame:
    """Totals at every level of a hierarchy; the closed levels read ``label``.

    A stored NULL in a key is told apart from a subtotal and stays NULL.
    """
    agg = missing.sum_strict if strict else F.sum
    # sum the leaves first: the roll-up copies each row once per level
    leaves = df.groupBy(*hierarchy).agg(*[agg(m).alias(m) for m in measures])
    grouped = leaves.rollup(*hierarchy).agg(
        *[agg(m).alias(m) for m in measures],
        *[F.grouping(k).alias(f"__g_{k}") for k in hierarchy],
    )
    return grouped.select(
        *[
            F.when(F.col(f"__g_{k}") == 1, F.lit(label)).otherwise(F.col(k)).alias(k)
            for k in hierarchy
        ],
        *measures,
    )


def append_subtotal(
    df: DataFrame, condition: Column, constants: Mapping[str, str], keys: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """Append the sum of the matching rows, with some keys set to constants."""
    kept = [k for k in keys if k not in constants]
    part = df.where(condition)
    total = (
        part.groupBy(*kept)
        .agg(*[missing.sum_strict(m).alias(m) for m in measures])
        .withColumns({k: F.lit(v) for k, v in constants.items()})
    )
    return df.select(*keys, *measures).unionByName(total)
