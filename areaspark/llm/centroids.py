"""Clusters of vectors around integer centroids, by progressive Walsh-Hadamard search.

Components become whole numbers, so every sum below is exact. The Walsh-Hadamard transform of
``size`` components multiplies all squared distances by ``size`` and gathers what is common to many
components in few coefficients. Its coefficients are taken coarse to fine (by number of sign changes):
differences of vector and centroid are squared and added up block by block. After the first block the
leading centroid is measured on all coefficients; a centroid whose partial sum exceeds that is strictly worse, as
sums only grow, and is left out of the next blocks. The others are finished and the smallest sum wins,
ties by the smaller number.

Each round is one pass over the vectors in tasks of any number; a task returns one row of counts and sums for each
centroid. Only centroids (``count`` of ``size`` numbers) reach the driver.

Cases: vectors that are null, of another length, or hold null or non-finite components take no part, nor do
components beyond 2 ** 27 / ``scale``, whose squared distances 64 bits can't hold. Rows of the same id are vectors of
their own. Rows without an id are assigned but are no first centroid. With fewer vectors than centroids there are as many centroids as
vectors; no vectors give no rows. Other columns are ignored. Empty centroids stay where they are. Summed distances beyond 64 bits
raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaspark.llm import common
from areaspark.session import keep as keep_table

COUNT, ROUNDS, SIZE, SCALE = 16, 3, 64, 64
#: Largest component whose squared distances fit 64 bits, and up to which the transform's do.
LARGEST, PLAIN = 1 << 27, 1 << 24
#: Vectors compared at a time.
AT_ONCE = 4_096


def transform(vectors: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the length is a power of two."""
    n, size = vectors.shape
    half = 1
    while half < size:
        pairs = vectors.reshape(n, -1, 2, half)
        vectors = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2)
        half *= 2
    return vectors.reshape(n, size)


def coarse_to_fine(size: int) -> np.ndarray:
    """Places of the coefficients by the number of sign changes of their rows."""
    rows = transform(np.eye(size, dtype=np.int64))
    return np.argsort((rows[:, 1:] != rows[:, :-1]).sum(1), kind="stable")


def steps(size: int) -> list[tuple[int, int]]:
    """Blocks of coefficients: the first four, then as many as all before."""
    ends = [min(4, size)]
    while ends[-1] < size:
        ends.append(min(2 * ends[-1], size))
    return list(zip([0, *ends], ends))


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row, and the squared distance to it."""
    size = vectors.shape[1]
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) > PLAIN:
        vectors, centroids = vectors.astype(object), centroids.astype(object)  # transformed squares beyond 64 bits
    order, wide = coarse_to_fine(size), transform(centroids)
    c = wide[:, order]
    found, far = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for at in range(0, len(vectors), AT_ONCE):
        x = transform(vectors[at : at + AT_ONCE])[:, order]
        row, col = np.divmod(np.arange(len(x) * len(c)), len(c))
        part = np.zeros(len(row), x.dtype)
        for low, high in steps(size):
            part = part + ((x[row, low:high] - c[col, low:high]) ** 2).sum(1)
            if not low:
                lead = c[part.reshape(len(x), -1).argmin(1)]
                most = ((x - lead) ** 2).sum(1)
            open_ = part <= most[row]
            row, col, part = row[open_], col[open_], part[open_]
        # the leading centroid of each row is still there, so every row has a stretch of sums
        start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        least = np.minimum.reduceat(part, start)
        first = np.flatnonzero(part == np.repeat(least, np.diff([*start, len(row)])))
        first = first[np.concatenate(([True], row[first][1:] != row[first][:-1]))]
        found.append(col[first].astype(np.int32))
        far.append((least // size).astype(np.int64))
    return np.concatenate(found), np.concatenate(far)


def whole_numbers(vector: Column, size: int = SIZE, scale: int = SCALE) -> Column:
    """Components times ``scale``, rounded down; null for a vector that takes no part."""
    scaled = F.transform(vector, lambda x: x.cast("double") * scale)
    fits = (F.size(vector) == size) & F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))
    return F.when(fits, F.transform(scaled, lambda x: F.floor(x).cast("int")))


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy().astype(np.int64).reshape(-1, size)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, list[int]]:
    """Componentwise sums divided by counts, rounded down, of every centroid that has vectors."""
    count, size = centroids.shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(count, np.int64), np.zeros((count, size), np.int64)
        for batch in batches:
            rows = _matrix(batch, size)
            cluster, _ = nearest(rows, centroids)
            n += np.bincount(cluster, minlength=count)
            np.add.at(total, cluster, rows)
        used = np.flatnonzero(n)
        cols = [pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["cluster", "n", "sums"])

    parts = vectors.select("vector").mapInArrow(task, "cluster int, n long, sums array<long>")
    parts = parts.select("cluster", "n", F.posexplode("sums").alias("place", "value"))
    exact = parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    found: dict[int, list[int]] = {}
    for r in exact.orderBy("cluster", "place").collect():  # count * size rows
        found.setdefault(r["cluster"], []).append(int(r["value"]) // r["n"])
    return found


def _assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    size = centroids.shape[1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, far = nearest(_matrix(batch, size), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster), pa.array(far)], names=["id", "cluster", "distance"])

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.mapInArrow(task, f"id {kind}, cluster int, distance long")


def cluster(
    df: DataFrame, vector: str = "embedding", id: str = "vec_id", count: int = COUNT, rounds: int = ROUNDS,
    size: int = SIZE, scale: int = SCALE, seed: int = 1,
) -> tuple[DataFrame, list[list[int]]]:
    """``id``, ``cluster``, ``distance`` (squared), ``cluster_inertia`` and ``inertia`` of every vector that takes part; the centroids.

    The first centroids are the vectors with the smallest SHA-256 of ``seed:id`` (ties: by components).
    """
    if size & (size - 1) or size < 1:
        raise ValueError("the number of components must be a power of two")
    common.needs(df, [vector, id])
    vectors = df.select(df[id].alias("id"), whole_numbers(df[vector], size, scale).alias("vector")).where("vector IS NOT NULL")
    vectors = keep_table(vectors, "vectors")
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = vectors.where("id IS NOT NULL").select(place.alias("place"), "vector").orderBy("place", "vector").limit(count).collect()
    centroids = np.array([r["vector"] for r in first], np.int64).reshape(-1, size)
    if not len(centroids):
        empty = vectors.limit(0).selectExpr("id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia")
        return empty.withColumnRenamed("id", id), []
    for _ in range(rounds):
        for k, mean in _sums(vectors, centroids).items():
            centroids[k] = mean
    found = keep_table(_assigned(vectors, centroids), "assigned")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row for each centroid
    of = {r["cluster"]: int(r["s"]) for r in sums}
    if sum(of.values()) >= 1 << 63:
        raise OverflowError("the summed squared distances exceed 64 bits")
    each = F.element_at(F.array(*[F.lit(of.get(k, 0)).cast("long") for k in range(len(centroids))]), F.col("cluster") + 1)
    found = found.select(F.col("id").alias(id), "cluster", "distance", each.alias("cluster_inertia"), F.lit(sum(of.values())).cast("long").alias("inertia"))
    return found, centroids.tolist()


def digest(centroid: list[int]) -> str:
    """SHA-256 of the components in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
