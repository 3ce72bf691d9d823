"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaspark.session import keep


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the smallest node it reaches) of every node with a link.

    Alternates two steps until nothing changes: every node hands its larger neighbours, then
    its smaller ones, to the smallest it knows. Each step is an aggregation and an equality
    join; results of a round are a written table, so a lost executor costs one round. A round
    never has more rows than there are links. Links to oneself and nulls are ignored; no links
    give no rows.
    """
    edges = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct()
    edges = keep(edges, "links")
    before = None
    while True:
        # larger neighbours of every node go to its smallest
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select("v", "m").where("v <> m").distinct()
        # smaller neighbours (now column m) of every node go to the smallest of them
        small = large.groupBy("v").agg(F.min("m").alias("low"))
        moved = large.join(small, "v").select(F.col("low").alias("u"), F.col("m").alias("v")).where("u < v")
        edges = keep(moved.union(small.select(F.col("low").alias("u"), "v")).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root")).union(
                edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
            ).groupBy("node").agg(F.min("root").alias("root"))
        before = now
