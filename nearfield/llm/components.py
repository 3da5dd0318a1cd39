"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism, written


def _with_least(edges: DataFrame, cells: int) -> DataFrame:
    """(a, b, m): each edge with the least b of its a.

    A hub may hold a third of all edges, so a node's edges are dealt over ``cells`` by b. Minima are taken by cell, then by
    node, and go back to those cells alone that the node has edges in.
    """
    dealt = edges.withColumn("cell", F.pmod(F.xxhash64("b"), F.lit(cells)).cast("int"))
    by_cell = dealt.groupBy("a", "cell").agg(F.min("b").alias("m"))
    by_node = by_cell.groupBy("a").agg(F.min("m").alias("m"), F.collect_list("cell").alias("cell"))  # at most ``cells`` each
    return dealt.join(by_node.select("a", F.explode("cell").alias("cell"), "m"), ["a", "cell"]).select("a", "b", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of (a, b): the least node that can be reached.

    Each pass takes two minima over neighbours, with no task holding a hub's edges alone; edges are written between
    passes. The number of passes grows with the logarithm of the longest path. Nothing comes to the driver but
    a count of changes. Edges with a null end join nothing.
    """
    cells = max(64, parallelism(edges.sparkSession))
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a != b")
    pairs = written(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # large star: a node's larger neighbours move to the least of its neighbourhood
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, cells).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = written(large.distinct(), "edges")
        # small star: a node's smaller neighbours, and itself, move to the least of them
        moved = _with_least(large, cells)
        small = moved.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        small = written(small, "edges")
        # done when every node has one parent that is a root
        parents = small.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        several = parents.where("n > 1").limit(1).count()
        chained = small.select("b").distinct().join(small.select(F.col("a").alias("child")), F.col("b") == F.col("child"), "left_semi").limit(1).count()
        pairs = small
        if not several and not chained:
            break
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
