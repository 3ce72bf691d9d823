"""Group totals, shares, counts and ids without one-task windows.

A window keeps a whole group in one task. Here the group value is computed by an
ordinary aggregation (partial sums on the map side) and joined back, so a group
with a third of all rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areaspark.functions import missing
from areaspark.operators import joins


def with_group_values(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """Add aggregates of each row's group to the row."""
    per_group = df.groupBy(*keys).agg(*[v.alias(n) for n, v in values.items()])
    return joins.null_safe_join(df, per_group, list(keys))


def with_group_total(
    df: DataFrame, keys: Sequence[str], value: str, name: str, strict: bool = True, bounded: bool = False
) -> DataFrame:
    """Total of each row's group.

    ``bounded``: the groups have a small known size, because the rows are already
    aggregated to a few per group. Then a window does it in one shuffle, without
    computing the input twice.
    """
    if bounded:
        group = Window.partitionBy(*keys)
        total = F.sum(value).over(group)
        if strict:
            total = F.when(F.count(value).over(group) == F.count(F.lit(1)).over(group), total)
        return df.withColumn(name, total)
    total = missing.sum_strict(value) if strict else F.sum(value)
    return with_group_values(df, keys, {name: total})


def with_share(
    df: DataFrame, keys: Sequence[str], value: str, name: str, strict: bool = True
) -> DataFrame:
    out = with_group_total(df, keys, value, "__total", strict)
    return out.withColumn(name, missing.ratio(value, "__total")).drop("__total")


def with_group_count(df: DataFrame, keys: Sequence[str], name: str = "count") -> DataFrame:
    return with_group_values(df, keys, {name: F.count(F.lit(1))})


def only_single_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs exactly once.

    One aggregation: a single row is its own minimum, so no window and no join.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.min(F.struct(*rest)).alias("__row")
    )
    return picked.where("__n = 1").select(
        *[F.col(c) if c in keys else F.col("__row").getField(c).alias(c) for c in df.columns]
    )


def surrogate_id(*cols: Column | str) -> Column:
    """Stable id of a row from its content; no ordering, no shuffle."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def dense_ids(
    df: DataFrame,
    order: Mapping[str, Column],
    name: str,
    keep: Callable[[DataFrame], DataFrame] | None = None,
    cuts: int = 64,
) -> DataFrame:
    """Consecutive ids from 1 in a global order, missing keys last.

    Rows are numbered inside ranges of the order and shifted by the size of the ranges
    before, so no task sees the whole table. With ``keep``, which writes a frame once, the
    ranges are as many as shuffle partitions and follow the size of the table; without it,
    as suits small tables, they are cut at a fixed sample of ``cuts`` keys. The ordering
    keys must identify a row.
    """
    keys = {f"__o{i}": c for i, c in enumerate(order.values())}
    keyed = df.withColumns(keys)
    # (is missing, value) sorts missing keys last
    by = [x for k in keys for x in (F.col(k).isNull(), F.col(k))]
    if keep is None:
        keyed = keyed.withColumn("__key", F.struct(*by))
        sample = (
            keyed.select("__key")
            .orderBy(F.xxhash64("__key"), "__key")
            .limit(cuts)
            .agg(F.sort_array(F.collect_list("__key")).alias("c"))
        )
        ranged = keyed.select("*", sample.scalar().alias("__cuts")).withColumn(
            "__range",
            F.size(F.filter("__cuts", lambda c: c <= F.col("__key"))),
        ).drop("__cuts", "__key")
    else:
        # part ids hold for the written frame only
        ranged = keep(keyed.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    # one row for each range reaches this window
    before = sizes.select(
        "__range",
        (
            F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0))
            - F.col("__n")
        ).alias("__before"),
    )
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*by))
    return (
        ranged.withColumn("__i", inside)
        .join(before, "__range")
        .withColumn(name, (F.col("__i") + F.col("__before")).cast("long"))
        .select(*df.columns, name)
    )


def relative_to_extreme(df: DataFrame, value: str, name: str) -> DataFrame:
    """Each value divided by the largest one of the column."""
    top = df.agg(F.max(value).alias("__max"))
    out = joins.attach_scalar(df, top)
    return out.withColumn(name, missing.ratio(value, "__max")).drop("__max")
