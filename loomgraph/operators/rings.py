"""Rings of transfers that conserve flow, made for tests and for injection into a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import graph, splits
from loomgraph.session import staged


def unit(salt: str, *parts) -> F.Column:
    """A number in [0, 1) from a hash: the same anywhere."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), *(p.cast("string") for p in parts))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def rings(spark: SparkSession, n: int, lengths: tuple[int, ...] = (3, 4, 5, 6), fee: float = 0.01, salt: str = "rings") -> DataFrame:
    """(ring, place, src, dst, time, amount): rings of new nodes; each hop passes on its amount less the fee, a while later."""
    return rings_of(spark.range(n).select(F.col("id").alias("ring")), lengths, fee, salt)


def rings_of(numbers: DataFrame, lengths: tuple[int, ...] = (3, 4, 5, 6), fee: float = 0.01, salt: str = "rings") -> DataFrame:
    """rings() with the given numbers (ring)."""
    ring = numbers.select("ring").distinct()
    size = F.element_at(F.array(*map(F.lit, lengths)), (F.floor(unit(salt, F.col("ring"), F.lit("size")) * len(lengths)) + 1).cast("int"))
    hops = ring.select("ring", size.alias("k")).select("ring", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("place"))
    node = lambda p: F.concat(F.lit("ring_"), F.col("ring").cast("string"), F.lit("_"), p.cast("string"))
    start, first = F.floor(unit(salt, F.col("ring"), F.lit("time")) * 1000), F.round(1000 + 9000 * unit(salt, F.col("ring"), F.lit("amount")), 2)
    return hops.select("ring", "place", node(F.col("place")).alias("src"), node(F.pmod(F.col("place") + 1, F.col("k"))).alias("dst"), (start + F.col("place")).alias("time"), (first * F.pow(F.lit(1 - fee), F.col("place"))).alias("amount"))


def inject(edges: DataFrame, made: DataFrame, bridges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """edges (by, src, dst, time, amount) with rings and, for each ring, an edge from a node of the graph to its first node. bridges: (by, ring, src)."""
    placed = made.join(bridges.select(*by, "ring"), "ring") if by else made
    first = placed.where("place = 0").select("ring", F.col("src").alias("dst"), "time", "amount")
    link = bridges.join(first, "ring").select(*by, "src", "dst", "time", "amount", F.lit(None).cast("bigint").alias("ring"))
    own = edges.select(*by, "src", "dst", "time", "amount", F.lit(None).cast("bigint").alias("ring"))
    return own.unionByName(link).unionByName(placed.select(*by, "src", "dst", "time", "amount", "ring"))


def ring_pool(edges: DataFrame, made: DataFrame, bridges: DataFrame, lengths: range, cap: int, most_paths: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, length, cycle, label): the candidates of a graph with injected rings. Cycles are searched blind in the joined graph, labelled by the injected edges, and carry neither ring nor event names."""
    joined = staged(inject(edges, made, bridges, by), "injected")
    found = graph.cycles(graph.arcs(joined, by), lengths, cap, by, most_paths)
    labels = splits.ring_labels(graph.cycle_arcs(found).select(*by, "cycle", "src", "dst"), joined.where("ring IS NOT NULL"), by)
    return found.join(labels, [*by, "cycle"]).select(*by, "length", "cycle", "label")
