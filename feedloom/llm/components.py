"""Connected components by alternating large and small stars, all on executors."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import drop_stored, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (a > b): link neighbours to the smallest node around."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if large:  # each larger neighbour goes to the minimum
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # each smaller neighbour and the node itself go to the minimum
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for nodes of `edges` (a, b), a > b: the smallest node
    reachable.  Nodes that are their own component's smallest are left out.
    The rounds needed grow with the logarithm of the longest chain."""
    now = stored(edges)
    seen = None
    for _ in range(most_rounds):
        new = stored(_star(_star(now, True), False))
        drop_stored(now)
        now = new
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = tuple(mark)
    raise RuntimeError("components did not settle")
