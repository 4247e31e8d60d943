"""Numbers in a total order without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import staged


def with_ordinal(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with its rows' numbers, from 0, in the order of the given columns, which should be a key. Rows are dealt by range and numbered inside a task; what comes before a task is a sum over one row for each task."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    mark = F.monotonically_increasing_id()
    made = staged(ranged.withColumn("_part", F.shiftright(mark, 33)).withColumn("_place", mark.bitwiseAND(F.lit((1 << 33) - 1))), "ordinals")
    before = made.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return made.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")
