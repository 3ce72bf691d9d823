"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "areaspark", **conf: str) -> SparkSession:
    """Session for tests and single-node runs; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus) if cpus != "*" else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        # columns need not remember the line of Python that made them; that costs a millisecond each
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for files passed between jobs.

    Uses the shared folder the cluster names in ``spark.checkpoint.dir``. Without
    one, a temporary folder is made, which only a local session may use.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        shared = tempfile.mkdtemp(prefix="areaspark-")
    path = os.path.join(shared, f"{name}-{uuid.uuid4().hex}")
    for made in _MADE:
        made.append(path)
    return path


#: Folders made inside each open :func:`scratch`.
_MADE: list[list[str]] = []


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more, in whatever store holds it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, the folders made inside: for steps whose result is written by then to an older folder."""
    made: list[str] = []
    _MADE.append(made)
    try:
        yield
    finally:
        _MADE.remove(made)
        for path in made:
            discard(spark, path)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate that several branches use, and read it back.

    It is computed once instead of once per branch, survives lost executors, and
    later plans start from a file scan with known size.
    """
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
