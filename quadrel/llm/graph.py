"""Connected components of an edge table, by stars that shrink to their smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.llm.base import splittable, written


def _least(pairs: DataFrame) -> DataFrame:
    """Pairs u, v with m: the smallest node among u and all v of it."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return pairs.join(splittable(least, "u"), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges have u > v here."""
    found = _least(edges)
    moved = found.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(found.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    n, mark = edges.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0)")).first()
    return n, mark


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node on an edge (columns u, v; longs); root is the smallest node of its component.

    Rounds grow with the logarithm of the longest chain. Each is written out, so lost executors cost one round.
    """
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        edges = written(_small_star(_large_star(edges)), "edges")
        now = _state(edges)
        if now == before:
            break
        before = now
    pairs = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root").distinct())
