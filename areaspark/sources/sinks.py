"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str) -> str:
    """CSV part files with a header each, written by all tasks."""
    df.write.mode("errorifexists").option("header", True).csv(path)
    return path


def write_lines(df: DataFrame, path: str) -> str:
    """One text column as lines, below its name in each file."""
    df.write.mode("errorifexists").option("header", True).option("sep", "\u0001").option("quote", "").csv(path)
    return path


def write_bad_rows(bad: DataFrame, path: str) -> int:
    """Quarantined rows with the file they come from, as Parquet; returns how many there are."""
    bad.write.mode("errorifexists").parquet(path)
    return bad.sparkSession.read.schema(bad.schema).parquet(path).count()


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> str:
    """Parquet stored by the columns later scans filter on.

    Rows are not shuffled to their partition value, so one large value does not
    end up in one task; each task writes its part of every value.
    """
    df.write.mode("errorifexists").partitionBy(*by).parquet(path)
    return path
