"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import cut


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (u, v); component is the smallest node that it reaches.

    Nodes are longs. Self loops, repeated edges and both directions are allowed; an edge with a null end is ignored.
    Each round is cut with a checkpoint; minima are combined before their shuffle, and only equality joins spread them.
    """
    edges = edges.select("u", "v").filter("u <> v")
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(edges)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        last, mark = mark, _mark(edges)
        if mark == last:
            break
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
