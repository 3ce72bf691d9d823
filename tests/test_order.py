"""Order across partitions, and places in it."""

import pytest
from compare import rows
from pyspark.sql import functions as F

from areaspark import session
from areaspark.operators import ordering


def keep(df):
    return session.keep(df, "order")


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def numbers(spark):
    # three of the keys hold most rows; some are missing
    key = F.when(F.col("id") % 11 == 0, F.lit(None)).when(F.col("id") % 2 == 0, F.col("id") % 3).otherwise(F.col("id") * 7919 % 500)
    return spark.range(5_000, numPartitions=6).select(key.alias("k"), F.col("id"))


@pytest.mark.parametrize("down", [(), ("k",)])
def test_sorted_frames_hold_over_partitions(spark, many_parts, down):
    ordered = ordering.sort_rows(numbers(spark), "k", "id", descending=down)
    assert ordering.order_breaks(ordered, "k", "id", keep=keep, descending=down).count() == 0
    got = rows(ordering.positions(ordered, keep))
    assert [r[2] for r in sorted(got, key=lambda r: r[2])] == list(range(1, 5_001))
    want = sorted(((r["k"], r["id"]) for r in numbers(spark).collect()), key=lambda r: (r[0] is None, -(r[0] or 0) if down else (r[0] or 0), r[1]))
    assert [r[:2] for r in sorted(got, key=lambda r: r[2])] == want


def test_breaks_are_found(spark, many_parts):
    ordered = ordering.sort_rows(numbers(spark), "k", "id")
    assert ordering.order_breaks(ordered, "k", "id", keep=keep, descending=("id",)).where("kind = 'row'").count() > 0
    # each partition is in order, the partitions are not
    shuffled = numbers(spark).repartition(5, "id").sortWithinPartitions(F.col("k").asc_nulls_last(), "id")
    kinds = {r["kind"] for r in ordering.order_breaks(shuffled, "k", "id", keep=keep).collect()}
    assert kinds == {"part"}
    assert ordering.order_breaks(numbers(spark).limit(0), "k", keep=keep).count() == 0
