"""Approximate nearest neighbours by an adaptive scan of dimensions within probed lists.

Vectors are scaled to length one and turned by a fixed random rotation, after which every block
of columns carries a like share of a distance. Centroids of a bounded sample split them into
lists; a list is kept in blocks of bounded size. A query probes its nearest lists. In a block,
squared distances are added up one block of columns after the other; after each, a candidate
is abandoned if its partial distance is larger than the k-th nearest distance so far allows,
by a test on the rotated columns. What survives gets the exact cosine of the original vectors,
in double precision.

Equal vectors are one candidate with its smallest ids, and equal queries are asked once,
so that a vector of which there are millions costs as much as any other. Rows that could
still be answers are merged by query.

Cases: vectors that are null, zero, hold nulls or non-finite numbers, or differ in length from
the most frequent length take no part, nor do rows with a null id; equal scores go to the smaller
id; repeated rows count once; no vectors or no queries give no rows; fewer candidates than k
give all of them, provided every list is probed (as it is in small tables); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areaspark.llm import common
from areaspark.session import keep as keep_table

#: Centroids are fitted to at most about so many vectors.
SAMPLE = 20_000
#: Lists at most; fewer for small tables (the square root of the number of vectors).
LISTS = 1_024
#: Share of the lists that a query probes, and how many at least. Vectors without clusters, whose
#: nearest neighbours have cosines near 0.5, need about this share for a recall over 0.9.
PROBED, PROBED_LEAST = 0.75, 16
#: Vectors in a block of a list at most, about.
BLOCK = 20_000
#: Columns added to a partial distance at a time.
COLUMNS = 16
#: Of the test that abandons candidates: larger keeps more of them.
CONFIDENCE = 2.1


class Index:
    """Rotation and centroids."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 7, rounds: int = 8):
        random = np.random.default_rng(seed)
        self.dims = sample.shape[1]
        self.turn = np.linalg.qr(random.standard_normal((self.dims, self.dims)))[0]
        points = self.rotated(sample)
        lists = max(1, min(lists, len(points)))
        self.centroids = points[random.choice(len(points), lists, replace=False)] if len(points) else np.zeros((1, self.dims))
        for _ in range(rounds if len(points) else 0):
            nearest = (points @ self.centroids.T).argmax(1)
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, nearest, points)
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            self.centroids = np.where(length > 0, sums / np.where(length > 0, length, 1), self.centroids)

    def rotated(self, vectors: np.ndarray) -> np.ndarray:
        x = vectors.astype(np.float64)
        x = x / np.abs(x).max(1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True) @ self.turn

    def nearest_lists(self, vectors: np.ndarray, n: int) -> np.ndarray:
        near = self.rotated(vectors) @ self.centroids.T
        n = min(n, near.shape[1])
        return np.argpartition(-near, n - 1, axis=1)[:, :n]


def cosine(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Cosine of a vector and each row, in double precision; equal rows get equal results."""
    a, b = one.astype(np.float64), many.astype(np.float64)
    return (b * a).sum(1) / (np.sqrt((b * b).sum(1)) * np.sqrt((a * a).sum()))


def scan(query: np.ndarray, turned: np.ndarray, blocks: list[np.ndarray], raw: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a block that can be among the k nearest of a query, with their cosines.

    ``turned``: the rotated query; ``blocks``: the rotated vectors, cut into blocks of columns.
    """
    n, dims = len(raw), len(turned)
    if n <= 4 * k:
        return np.arange(n), cosine(query, raw)
    cuts = np.cumsum([0] + [b.shape[1] for b in blocks])
    part = ((blocks[0] - turned[: cuts[1]]) ** 2).sum(1)
    # the k-th nearest of the most promising candidates bounds the search
    best = np.argpartition(part, 2 * k)[: 2 * k]
    full = sum(((b[best] - turned[lo:hi]) ** 2).sum(1) for b, lo, hi in zip(blocks, cuts, cuts[1:]))
    bound = np.partition(full, k - 1)[k - 1] * (1 + 1e-9) + 1e-12
    alive = np.arange(n)
    for block, lo, hi in zip(blocks[1:], cuts[1:], cuts[2:]):
        likely = part <= bound * lo / dims * (1 + CONFIDENCE / np.sqrt(lo)) ** 2
        alive, part = alive[likely], part[likely]
        part = part + ((block[alive] - turned[lo:hi]) ** 2).sum(1)
    alive = alive[part <= bound]
    return alive, cosine(query, raw[alive])


def _matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)


def _valid(df: DataFrame, id: str, vector: str) -> DataFrame:
    """Ids and vectors that take part, a distinct row each."""
    v = F.col("v")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    known = df.select(df[id].cast("long").alias("id"), df[vector].cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull())
    known = known.where(F.coalesce(ok, F.lit(False)))
    sizes = known.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    return known.where(F.size("v") == (sizes["n"] if sizes else 0))


def _packed(df: DataFrame) -> DataFrame:
    """The vectors as binary, 64-bit little-endian floats."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                raw = pa.array([row.tobytes() for row in flat], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id"), raw], names=["id", "v"])

    return df.mapInArrow(task, "id long, v binary")


def nearest(df: DataFrame, is_query: Column, id: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (cosine) of the k nearest of each query.

    ``is_query`` is a condition on the column ``id`` (as a long integer).
    """
    common.needs(df, [id, vector])
    rows = keep_table(_packed(_valid(df, id, vector)), "vectors")
    # of equal vectors, the k + 1 smallest ids can be answers: one of them may be the query's own
    order = Window.partitionBy("v").orderBy("id")
    ids = rows.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    points = keep_table(ids.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("at", F.xxhash64("v")), "points")
    n = points.count()
    share = min(1_000_000, 1_000_000 * SAMPLE // max(n, 1) + 1)
    some = points.where(F.pmod("at", F.lit(1_000_000)) < share).orderBy("at", "v").limit(SAMPLE).select("v").collect()
    if not some:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).where("false")
    index = Index(_matrix([r["v"] for r in some]), min(LISTS, int(n**0.5)))
    lists = len(index.centroids)
    probed = min(lists, max(PROBED_LEAST, int(PROBED * lists)))

    def placed(frame: DataFrame, many: int, *more: str) -> DataFrame:
        """The frame, once for each of the ``many`` nearest lists."""

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near = index.nearest_lists(_matrix(batch.column("v").to_pylist()), many)
                    rows = np.repeat(np.arange(batch.num_rows), near.shape[1])
                    cols = [batch.column(c).take(pa.array(rows)) for c in ("v", *more)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(near.ravel().astype(np.int32))], names=["v", *more, "list"])

        kinds = {"ids": "array<long>", "at": "long"}
        return frame.select("v", *more).mapInArrow(task, ", ".join(["v binary", *(f"{c} {kinds[c]}" for c in more), "list int"]))

    held = keep_table(placed(points, 1, "ids", "at"), "lists")
    sizes = F.broadcast(held.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))  # at most LISTS rows
    held = held.join(sizes, "list").select("list", F.pmod("at", F.col("blocks")).cast("int").alias("block"), "v", "ids")
    asked = rows.where(is_query).select("v").distinct()
    asked = placed(asked, probed).join(sizes, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "v")

    def search(mine: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(mine) and len(queries):
            raw = _matrix(list(mine["v"]))
            turned = index.rotated(raw)
            blocks = [np.ascontiguousarray(turned[:, c : c + COLUMNS]) for c in range(0, index.dims, COLUMNS)]
            wanted = _matrix(list(queries["v"]))
            least = np.array([i[0] for i in mine["ids"]])
            for v, query, q in zip(queries["v"], wanted, index.rotated(wanted)):
                at, score = scan(query, q, blocks, raw, k + 1)
                best = np.lexsort((least[at], -score))[: k + 1]
                found += [(v, list(mine["ids"].iloc[at[b]]), float(score[b])) for b in best]
        return pd.DataFrame(found, columns=["v", "ids", "score"])

    near = held.groupBy("list", "block").cogroup(asked.groupBy("list", "block")).applyInPandas(search, "v binary, ids array<long>, score double")
    flat = near.select("v", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("v").orderBy(F.desc("score"), "vec_id")
    flat = flat.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("v", "vec_id", "score")
    queries = rows.where(is_query).select(F.col("id").alias("query_id"), "v").distinct()
    met = queries.join(flat, "v").where(F.col("query_id") != F.col("vec_id"))
    met = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
