"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import scratch, stored


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of longs -> ``(node, comp)``: every node's smallest reachable node.

    Each round rewires the graph with two grouped minima and two joins, and is written to the
    shared folder; a graph of diameter d needs O(log d) rounds. Nodes without an edge (or only
    with an edge to themselves) are not returned. No adjacency list is ever collected. Rows of a
    hub are pairs of longs; the joins are sort-merge joins between exchanges, whose skewed
    partitions adaptive execution splits.
    """
    with scratch(edges.sparkSession) as s:
        e = stored(_ordered(edges.select(F.col("u").alias("a"), F.col("v").alias("b"))))
        for _ in range(max_rounds):
            if _is_star_forest(e):
                break
            e = stored(_small_star(_large_star(e)))
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        s.keep(e)
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("comp", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)


def _ordered(e: DataFrame) -> DataFrame:
    return e.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(low, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.withColumnRenamed("m", "b")).distinct()


def _is_star_forest(e: DataFrame) -> bool:
    """Each node points to one node only, and that one points nowhere."""
    tops = e.select(F.col("b").alias("a")).distinct().withColumn("n", F.lit(1))
    seen = e.select("a").withColumn("n", F.lit(1)).unionByName(tops)
    return seen.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
