"""Sorting with missing values last, and domain orders."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sort_rows(df: DataFrame, *keys: Column | str, descending: Sequence[str] = ()) -> DataFrame:
    """Range-partitioned global sort, missing values last in either direction."""
    order = []
    for k in keys:
        if isinstance(k, str):
            order.append(F.col(k).desc_nulls_last() if k in descending else F.col(k).asc_nulls_last())
        else:
            order.append(k.asc_nulls_last())
    return df.orderBy(*order)


_PART = 33  # bits of a row's number within its partition


def positions(ordered: DataFrame, keep: Callable[[DataFrame], DataFrame], name: str = "position") -> DataFrame:
    """Place of every row of a sorted frame, from 1, as its partitions hold it.

    The frame is written once by ``keep`` (see :func:`areaspark.session.keep`) with each row's partition and number; the offsets of the
    partitions are the only thing worked out in one task.
    """
    written = keep(ordered.withColumn("__at", F.monotonically_increasing_id()))
    part, row = F.shiftright("__at", _PART), F.col("__at").bitwiseAND((1 << _PART) - 1)
    placed = written.withColumns({"__part": part, "__row": row}).drop("__at")
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))  # a row for each partition
    numbered = placed.join(offsets, "__part").withColumn(name, F.col("__before") + F.col("__row") + 1)
    return numbered.drop("__part", "__row", "__before")


def order_breaks(ordered: DataFrame, *keys: str, keep: Callable[[DataFrame], DataFrame], descending: Sequence[str] = ()) -> DataFrame:
    """Where a frame is out of order: ``part``, ``row`` and ``kind`` ("row": after its neighbour within a partition, "part": the
    last row of a partition after the first one of the next). No rows, if the order holds throughout.

    Partitions are checked side by side; between them only their first and last keys meet.
    """
    written = keep(ordered.select(*keys, F.monotonically_increasing_id().alias("__at")))
    placed = written.select(F.struct(*keys).alias("k"), F.shiftright("__at", _PART).alias("part"), F.col("__at").bitwiseAND((1 << _PART) - 1).alias("row"))

    def in_order(a: Column, b: Column) -> Column:
        out = F.lit(True)
        for k in reversed(keys):
            x, y = a[k], b[k]
            first = F.coalesce(x > y if k in descending else x < y, F.lit(False)) | (x.isNotNull() & y.isNull())
            out = first | (x.eqNullSafe(y) & out)
        return out

    here = Window.partitionBy("part").orderBy("row")
    inner = placed.withColumn("next", F.lead("k").over(here)).where(F.col("next").isNotNull() & ~in_order(F.col("k"), F.col("next")))
    ends = placed.groupBy("part").agg(F.min_by("k", "row").alias("low"), F.max_by("k", "row").alias("high"), F.max("row").alias("row"))
    between = ends.withColumn("next", F.lead("low").over(Window.orderBy("part"))).where(F.col("next").isNotNull() & ~in_order(F.col("high"), F.col("next")))
    return inner.select("part", "row", F.lit("row").alias("kind")).union(between.select("part", "row", F.lit("part")))


def category_rank(col: Column | str, levels: Sequence[str]) -> Column:
    """Position of a value in a domain order, from 1; NULL when not listed."""
    c = F.col(col) if isinstance(col, str) else col
    at = F.array_position(F.array(*[F.lit(x) for x in levels]), c)
    return F.when(at > 0, at)


def first_rows(df: DataFrame, keys: Sequence[str], n: int = 6) -> DataFrame:
    """The first ``n`` rows in key order; per-task top-n, no full sort."""
    return df.orderBy(*[F.col(k).asc_nulls_last() for k in keys]).limit(n)
