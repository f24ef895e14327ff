"""Connected components of a graph given by edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewitness.session import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of edges (a, b) of longs; component is the smallest node reachable.

    Each round links every node's larger neighbours, and then its smaller ones, to the least of them;
    the number of rounds grows with the logarithm of the nodes. Hubs meet partial minima and inner joins
    that adaptive execution may split; rounds are written tables, so a lost executor repeats one at most.
    """
    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, seen = stage(now, "edges"), None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where((F.col("y") > F.col("x")) & (F.col("y") != F.col("m"))).select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        now = stage(small, "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
