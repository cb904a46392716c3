"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logrung.session import landed


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each node of ``edges`` (a, b).

    Alternates large-star and small-star steps until nothing changes, each a
    grouping by node with a minimum, so rounds grow with the logarithm of the
    longest path. Every round is written and read back: lineage stays short
    and a lost executor costs a read. Loops (a = b) and repeated edges do no harm.
    """
    now = landed(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    while True:
        # Large star: every larger neighbour of a node moves to the node's smallest neighbour.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = landed(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), "edges")
        state = _state(large)
        if state == _state(now) and state[0] == now.select("a").distinct().count():
            # Each node has one smaller neighbour and no larger neighbour moves: a forest of stars.
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
        # Small star: the smaller neighbours of a node, and the node, move to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        now = landed(small, "edges")


def _state(edges: DataFrame) -> tuple:
    """Count and two hash sums of a set of edges."""
    low = F.expr("xxhash64(a, b) & 4294967295")
    high = F.shiftright(F.xxhash64("a", "b"), 32)
    return tuple(edges.agg(F.count("*"), F.sum(low), F.sum(high)).first())
