"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import dropped, written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) edges between longs, or any values with an order -> (node, component), component = smallest reachable node.

    Each round rewires every neighbour to the smallest known node and writes
    the edges to the shared folder; a hub's edges are only joined with its one
    minimum, which adaptive skew handling can split. Loops and nulls are
    ignored; a node that is its own component (a root, or without edges) has no row.
    """
    e = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(low.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = written(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        dropped(e)
        e = new
        # done when all edges are stars: no node has two targets, none is a target and has one
        if e.groupBy("a").agg(F.count("*").alias("c")).where("c > 1").isEmpty() and e.join(e.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = written(e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node"), "components")
    dropped(e)
    return found
