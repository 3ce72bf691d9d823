"""Helpers of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of a task are worked off in pieces of about so many characters.
PIECE_CHARS = 2_000_000


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII text takes the quicker built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once; a value named inside a lambda is worked out for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def needs(df: DataFrame, columns: Sequence[str]) -> None:
    """Stop early, with the missing names, if a table lacks columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in {df.columns}")


def schema_of(df: DataFrame, keep: Sequence[str], **added: T.DataType) -> T.StructType:
    """The kept columns of a frame followed by new ones."""
    clash = set(keep) & set(added)
    if clash:
        raise ValueError(f"kept columns have the names of results: {sorted(clash)}")
    return T.StructType([df.schema[c] for c in keep] + [T.StructField(k, v) for k, v in added.items()])


def pieces(batch: pa.RecordBatch, text: str, most: int = PIECE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``most`` bytes of text; a longer text is a piece by itself."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def checked_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    """A broadcast hint for a side whose counted rows keep to a bound; otherwise the optimizer decides."""
    return F.broadcast(df) if rows <= most else df
