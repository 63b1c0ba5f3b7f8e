"""Connected components of an edge table, by alternating large and small stars.

Edges are rewired towards the smallest node id of their neighbourhood until
nothing changes; every round is a minimum per node (which combines before the
shuffle) and a join, so a node with very many edges is no single task's work.
Each round is stored, and only a count and a checksum come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is tied to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def connected_components(edges: DataFrame, work: Workspace) -> DataFrame:
    """node, root: the smallest node of its component, for every node of edges (a, b) that is not its root."""
    edges = work.store(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        after = work.store(_small_star(_large_star(edges)), "stars")
        work.drop(edges)
        edges = after
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == state:
            out = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out._tramline_path = edges._tramline_path
            return out
        state = now
