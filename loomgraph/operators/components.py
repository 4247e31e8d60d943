"""Connected components of a graph given as a table of edges, by alternating large-star and small-star steps.

A large-star step links each node's larger neighbours to the least node around it, a small-star step links a node and its smaller
neighbours to the least of them; the edges end as stars around the least node of each component. Only minima are gathered for
a node, never its neighbours, and every join has two written tables below it, so that a node with very many edges can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import discard, staged


def stars(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(a, b): each node a that isn't the least of its component, with that least node b. edges: (a, b), neither null."""
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first()
        if seen == mark or not seen[0]:
            return now
        mark = seen
        both = now.union(now.select("b", "a"))
        around = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        least = around.withColumnRenamed("a", "u")
        large = staged(both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        below = staged(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        least = below.withColumnRenamed("a", "u")
        small = large.join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, now = now, staged(small.union(least.select("u", "m")).distinct(), "edges")
        discard(before, around, large, below)  # a round's tables go with it
    raise RuntimeError(f"no end after {most_rounds} rounds")
