"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the least node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    others = down.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: rows (a, b) of an orderable type, a != b, in any order. Returns (node, component): the least node each
    node can reach, for the nodes of edges that aren't it. Neighbourhoods are never collected: each round keeps one
    minimum a node. Rounds stop when the edges are stars that no longer change."""
    now, mark = durable(edges.select("a", "b"), "links"), None
    while True:
        now = durable(_small(_large(now)), "stars")
        r = now.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
        if (r.n, r.x) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = (r.n, r.x)
