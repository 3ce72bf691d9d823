"""Registry of queries over the driver tables and of their reference SQL.

A *shape* (``px_*``) is SQL text that gives driver tables the form of an input
table; the same text runs on Spark and on the checking engine. A *view* (``ox_*``)
is a step of reference SQL only.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from areaspark import session

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]
SHAPES: dict[str, str] = {}
VIEWS: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_NAME = re.compile(r"\b([po]x_\w+)\b")
_TABLE = re.compile(r"\b(FROM|JOIN)\s+(\w+)\b")


class Tables:
    """Driver tables and shapes of one folder, as lazy frames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or not (name in BASE or name in SHAPES):
            raise AttributeError(name)
        if name not in self._frames:
            if name in BASE:
                frame = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                frame = self.sql(SHAPES[name])
            self._frames[name] = frame
        return self._frames[name]

    def put(self, name: str, frame: DataFrame) -> None:
        """Read a shape from a frame instead of its SQL."""
        self._frames[name] = frame

    def kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """An intermediate used by several branches of one query, written once."""
        key = f"_kept_{name}"
        if key not in self._frames:
            self._frames[key] = session.keep(make(), name)
        return self._frames[key]

    def sql(self, text: str) -> DataFrame:
        """Run SQL whose FROM/JOIN names are driver tables or shapes."""
        used: dict[str, DataFrame] = {}

        def swap(m: re.Match) -> str:
            word, name = m.groups()
            if name in BASE or name in SHAPES:
                used[name] = getattr(self, name)
                return f"{word} {{{name}}}"
            return m.group(0)

        text = _TABLE.sub(swap, text)
        return self.spark.sql(text, **used)


def shape(name: str, text: str) -> None:
    SHAPES[name] = text


def view(name: str, text: str) -> None:
    VIEWS[name] = text


def oracle_text(body: str) -> str:
    """Reference SQL with every shape and view it needs put in front."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in dict.fromkeys(_NAME.findall(text)):
            source = SHAPES.get(name) or VIEWS.get(name)
            if source is None or name in order:
                continue
            need(source)
            if name not in order:
                order.append(name)

    need(body)
    if not order:
        return body.strip()
    parts = [f"{n} AS ({(SHAPES.get(n) or VIEWS[n]).strip()})" for n in order]
    body = body.strip()
    if re.match(r"(?i)with\s", body):
        return "WITH " + ", ".join(parts) + ", " + re.sub(r"(?i)^with\s", "", body, count=1)
    return "WITH " + ", ".join(parts) + " " + body


def query(key: str, sql: str | None = None):
    """Register a function of :class:`Tables`, and its reference SQL."""

    def add(fn: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return add
