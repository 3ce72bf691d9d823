"""Collects all registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from areaspark.queries import registry


def _import_all() -> None:
    from areaspark.queries import (  # noqa: F401
        aggregates, filters, indicators, joining, people, places, scalars, scans, shapes,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _import_all()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _import_all()
    return {k: registry.oracle_text(v) for k, v in registry.ORACLE.items()}
