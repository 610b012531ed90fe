"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step needs the smallest neighbour of each node, which is a minimum with sums in each task first, and
joins it back, which Spark may split where a node has very many edges. Edges are written to the shared folder
after each round, so no plan grows and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import discard, same_place, staged


def _star(edges: DataFrame, name: str) -> DataFrame:
    """Edges (a, b) with a > b become (a, m) and (b, m), m the smallest b of a."""
    least = staged(edges.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m")), f"{name}-least")
    joined = edges.join(least, F.col("a") == F.col("of"))
    pairs = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    out = staged(pairs.filter("a > b").distinct(), name)
    discard(least)
    return out


def _large(edges: DataFrame, name: str) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour or itself."""
    both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
    least = staged(both.groupBy(F.col("a").alias("of")).agg(F.least(F.first("a"), F.min("b")).alias("m")), f"{name}-least")
    # the larger end of each edge goes to the smallest neighbour of the smaller end
    out = staged(edges.join(least, F.col("b") == F.col("of")).select("a", F.col("m").alias("b")).filter("a > b").distinct(), name)
    discard(least)
    return out


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges``: a, b (long). Returns node, root (the smallest node of its component) for every node that is
    in an edge between different nodes and isn't the root itself; ``discard`` removes it."""
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), name)
    while True:
        parents = now.select(F.col("b").alias("p")).distinct()
        twice = now.groupBy("a").agg(F.count("*").alias("k")).filter("k > 1").limit(1)
        chained = now.join(parents, F.col("a") == F.col("p"), "left_semi").select("a").limit(1)
        if not twice.union(chained.withColumn("k", F.lit(0).cast("long"))).limit(1).collect():
            return same_place(now.select(F.col("a").alias("node"), F.col("b").alias("root")), now)
        large = _large(now, name)
        discard(now)
        now = _star(large, name)
        discard(large)
