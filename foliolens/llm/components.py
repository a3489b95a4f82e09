"""Connected components by alternating stars; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base


def _state(edges: DataFrame) -> tuple:
    """Count and digest of an edge table: two numbers, so no edge reaches the driver."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node of an edge: the smallest node it can reach.

    A node keeps its links as a plain aggregate (the minimum of its neighbours), never as a list; a node with very many
    links is dealt over salted tasks. The number of rounds grows with the logarithm of the longest path.
    """
    pair = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = base.staged(pair.distinct(), "edges")
    before = _state(now)
    while before[0]:
        # large star: what is greater than a node moves to the least of the node and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = base.salted_join(both.where(F.col("v") > F.col("u")), least, ["u"], "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        # small star: a node and its smaller neighbours move to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = base.salted_join(large, least, ["u"], "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, now = now, base.staged(small.where(F.col("u") != F.col("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        base.drop_staged(old)
        after = _state(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
