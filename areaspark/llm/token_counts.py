"""Token counts of documents in flat token files without an index.

A token file is a run of little-endian integers of one width in which every document ends
with a separator id. Files are cut into blocks of equal size, wherever documents end; a
vectorised search finds the separators of a block. A prefix scan over the blocks of a file, one small
row each, carries the number of documents and the last separator before a block, which
gives the document that a block's first separator ends its number and length.

Files are read and written by their URI from within tasks (local, HDFS or object stores
that pyarrow knows). A task writes under a fresh name and hands that name on in its rows,
so a repeated task leaves at most an unused file.

Cases: an empty file has no documents; two separators in a row end an empty document (a null
or empty text is one); tokens after the last separator are a document that is not ended; a file
whose size is no multiple of the width is refused; repeated documents are counted each;
other columns are ignored. A document may span any number of blocks.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areaspark.llm import bpe, common

#: Bytes of a block, and of a file at most, about.
BLOCK, FILE = 4 << 20, 256 << 20
SEPARATOR = "<|endoftext|>"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def separator_of(path: str) -> int:
    return bpe.codec(path).added[SEPARATOR]


def width_of(path: str) -> int:
    """Bytes of a token: 2 if all ids fit, else 4."""
    return 2 if max(bpe.codec(path).bytes_of) < 1 << 16 else 4


def write_files(df: DataFrame, folder: str, text: str = "text", keep: Sequence[str] = ("doc_id",), path: str | None = None) -> DataFrame:
    """Encode texts into flat files; a row for each document: the kept columns, ``file``, ``size`` in bytes after it, and ``number`` in the file.

    The frame must be materialised once and read from there: every run of its plan writes files.
    """
    path = path or bpe.default_path()
    common.needs(df, [text, *keep])
    schema = common.schema_of(df, keep, file=T.StringType(), size=T.LongType(), number=T.LongType())
    df = df.select(*keep, df[text].alias("_text"))
    kind, end = f"<u{width_of(path)}", np.array([separator_of(path)], f"<u{width_of(path)}").tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.codec(path)
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        out, name, size, number = None, "", 0, 0
        for batch in batches:
            for piece in common.pieces(batch, "_text", bpe.PIECE):
                if out is None or size >= FILE:
                    if out is not None:
                        out.close()
                    file = f"tokens-{uuid.uuid4().hex}.bin"
                    name, size, number = os.path.join(folder, file), 0, 0
                    out = store.open_output_stream(os.path.join(base, file))
                sizes = []
                for ids in coder.encode_many(piece.column("_text").to_pylist(), special=False):
                    size += out.write(np.frombuffer(ids, "<u4").astype(kind).tobytes() + end)
                    sizes.append(size)
                cols = [piece.column(c) for c in keep]
                cols += [pa.array([name] * len(sizes)), pa.array(sizes, pa.int64()), pa.array(range(number, number + len(sizes)), pa.int64())]
                number += len(sizes)
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "file", "size", "number"])
        if out is not None:
            out.close()
        coder.forget()

    return df.mapInArrow(task, schema)


def files_in(spark: SparkSession, folder: str, pattern: str = "*.bin") -> DataFrame:
    """``file`` and ``size`` of the token files in a folder; their content isn't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return found.select(F.col("path").alias("file"), F.col("length").alias("size"))


def count(files: DataFrame, separator: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """``file``, ``number`` of the document in it (from 0), ``n_tokens`` without separator, ``ended``.

    ``files`` has the columns file and size.
    """
    if block % width:
        raise ValueError("a block holds whole tokens")
    bad = F.raise_error(F.concat(F.lit("no whole number of tokens in "), "file"))
    files = files.select("file", F.when(F.col("size") % width == 0, F.col("size")).otherwise(bad.cast("long")).alias("size"))
    last = F.floor((F.col("size") - 1) / block)
    blocks = files.where("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, at in zip(*(batch.column(c).to_pylist() for c in ("file", "size", "block"))):
                store, path = _open(file)
                with store.open_input_file(path) as f:
                    raw = f.read_at(min(block, size - at * block), at * block)
                ends = np.flatnonzero(np.frombuffer(raw, f"<u{width}") == separator) + at * block // width
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([size]), pa.array([at]), pa.array([ends.tolist()], pa.list_(pa.int64()))],
                    names=["file", "size", "block", "ends"],
                )

    found = blocks.repartition("file", "block").mapInArrow(task, "file string, size long, block long, ends array<long>")
    # the scan: what earlier blocks of the file know
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    seen = found.select(
        "*", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).cast("long").alias("first"),
        F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))).over(before), F.lit(-1)).cast("long").alias("end_before"),
    )
    at, ends = F.col("i"), F.col("ends")
    inside = seen.select("file", "first", "end_before", "ends", F.posexplode("ends").alias("i", "end")).select(
        "file", (F.col("first") + at).alias("number"),
        (F.col("end") - F.when(at > 0, F.get(ends, at - 1)).otherwise(F.col("end_before")) - 1).alias("n_tokens"), F.lit(True).alias("ended"),
    )
    last_end = F.coalesce(F.try_element_at("ends", F.lit(-1)), "end_before")
    rest = seen.where((F.col("block") + 1) * block >= F.col("size")).select(
        "file", (F.col("first") + F.size("ends")).alias("number"), (F.col("size") / width - 1 - last_end).cast("long").alias("n_tokens"), F.lit(False).alias("ended"),
    ).where("n_tokens > 0")
    return inside.unionByName(rest)
