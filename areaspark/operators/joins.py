"""Joins whose keys treat NULL as equal.

No join here forces a broadcast or salts its keys: the optimizer's size thresholds and,
at run time, the measured shuffle sizes decide. A key that holds much of the left side is
spread by adaptive execution, which cuts its shuffle partition between map tasks, however
equal its rows are; inner, left, semi and anti joins keep that way open. Sessions
switch on ``spark.sql.adaptive.forceOptimizeSkewedJoin``, so that an aggregation on the
same keys above the join doesn't keep it from being split.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in set(right.columns)]


def null_safe_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] | Mapping[str, str] | None = None,
    how: str = "inner",
) -> DataFrame:
    """Equi join in which NULL keys match; each key column appears once.

    ``on`` is a list of shared names, a mapping left name -> right name, or None
    for all shared names. Non-key columns present on both sides get ``.y``
    appended on the right.
    """
    if on is None:
        on = common_columns(left, right)
    pairs = dict(on) if isinstance(on, Mapping) else {c: c for c in on}
    if not pairs:
        raise ValueError("the two sides share no column to join on")
    key_of = {r: l for l, r in pairs.items()}
    renamed = right.select(
        [
            F.col(f"`{c}`").alias(
                f"__k_{key_of[c]}"
                if c in key_of
                else (f"{c}.y" if c in left.columns else c)
            )
            for c in right.columns
        ]
    )
    cond = reduce(
        lambda a, b: a & b,
        [left[f"`{l}`"].eqNullSafe(renamed[f"`__k_{l}`"]) for l in pairs],
    )
    joined = left.join(renamed, cond, how)
    if how in ("left_semi", "left_anti"):
        return joined
    rest = [F.col(f"`{c}`") for c in renamed.columns if not c.startswith("__k_")]

    def key(name: str) -> Column:
        if how in ("full", "full_outer", "outer"):
            # a NULL key that matched a NULL key coalesces to NULL again
            return F.coalesce(left[f"`{name}`"], renamed[f"`__k_{name}`"]).alias(name)
        if how in ("right", "right_outer"):
            return renamed[f"`__k_{name}`"].alias(name)
        return left[f"`{name}`"].alias(name)

    return joined.select(
        [key(c) if c in pairs else left[f"`{c}`"] for c in left.columns] + rest
    )


def attach_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Every column of a one-row frame on every row.

    Planned as a scalar subquery: the row is computed once and inserted as a
    constant; more than one row is an error, not a silent product.
    """
    names = one_row.columns
    packed = one_row.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("s")).scalar()
    return df.select("*", packed.alias("__one")).select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[F.col("__one").getField(c).alias(c) for c in names],
    )


def flag_exists(df: DataFrame, other: DataFrame, on: Sequence[str], flag: str) -> DataFrame:
    """1 when the key occurs in ``other``, else 0; never multiplies rows."""
    keys = other.select(*on).distinct().withColumn(flag, F.lit(1))
    return null_safe_join(df, keys, on, "left").withColumn(flag, F.coalesce(flag, F.lit(0)))


def join_valid_time(
    events: DataFrame,
    history: DataFrame,
    on: Sequence[str],
    at: str,
    start: str,
    end: str,
    first: str,
    last: str,
) -> DataFrame:
    """Join each event to the history rows whose half-open period holds it.

    ``first``/``last`` bound the event window (inclusive dates). Periods are cut
    to the window and spread over its years, and the year joins as an equality key:
    an open period costs one copy per year of the window, and a subject's events meet
    the periods of their own year only.
    """
    lo, hi = F.lit(first).cast("date"), F.lit(last).cast("date")
    windowed = events.where(
        (F.col(at) >= lo.cast("timestamp_ntz"))
        & (F.col(at) < F.date_add(hi, 1).cast("timestamp_ntz"))
    ).withColumn("__year", F.year(at))
    from_ = F.greatest(F.col(start).cast("date"), lo)
    to = F.least(F.coalesce(F.col(end).cast("date"), hi), hi)
    spread = (
        history.where((F.col(start).cast("date") <= hi) & (from_ <= to))
        .withColumn(
            "__year",
            F.explode(F.sequence(F.year(from_), F.year(to))),
        )
    )
    joined = null_safe_join(windowed, spread, [*on, "__year"])
    return joined.where(
        (F.col(at) >= F.col(start)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    ).drop("__year")


def assemble_wide(parts: Sequence[tuple[DataFrame, str]], keys: Sequence[str]) -> DataFrame:
    """Fold frames that share an area key into one wide frame.

    ``parts`` pairs each frame with its join type; a column already present is
    taken from the earlier frame. All joins use the same key, so the rows are
    hash-partitioned once.
    """
    (out, _), *rest = parts
    for frame, how in rest:
        fresh = [c for c in frame.columns if c not in keys and c not in out.columns]
        out = null_safe_join(out, frame.select(*keys, *fresh), list(keys), how)
    return out
