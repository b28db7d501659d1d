"""Connected components as DataFrame joins: alternating large-star and small-star steps over written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, freed, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Nodes may be of any orderable type. Null ends, loops, repeated and reversed edges are allowed and add nothing (a
    loop alone makes no node). Each step replaces edges by edges to smaller nodes, so the table never outgrows twice
    the input; the number of steps grows with the logarithm of the longest chain. No step needs a node's neighbours
    together: minima are pre-aggregated and written, so the join back has two plain sides and AQE can broadcast the
    minima or split a node with very many edges.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = written(edges.distinct(), "edges")
    before = None
    while True:
        after = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if after == before or not after["n"]:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(edges.select("v", "v").distinct())
        before = after
        both = edges.union(edges.select("v", "u"))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = written(large, "large_star")
        lower = written(large.groupBy("u").agg(F.min("v").alias("m")), "lower")
        small = large.join(lower, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower)
        old, edges = edges, written(small.distinct(), "edges")
        dropped(old, large, least, lower)
        freed(edges.sparkSession)
