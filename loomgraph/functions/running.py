"""Running sums within groups, in one window where groups are small and over ranges of rows where one isn't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import staged

#: Rows of a group that one window may hold.
MOST = 1 << 20


def running(df: DataFrame, by: list[str], order: Column, sums: dict[str, str], most: int = MOST) -> DataFrame:
    """df with the sums of columns over the rows of the same group up to each row, {new name: column}. by and order should be a key.

    A group of more than `most` rows isn't gathered: rows are dealt by range of (by, order), summed in windows of one range, and what comes before a range is a sum over a row for each range.
    Both ways give the same sums.
    """
    rows = staged(df, "running")
    largest = rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    up_to = lambda *keys: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    if largest <= most:
        return rows.select("*", *(F.sum(c).over(up_to(*by)).alias(n) for n, c in sums.items()))
    ranged = staged(rows.repartitionByRange(*by, order).withColumn("_range", F.spark_partition_id()), "ranges")
    inner = ranged.select("*", *(F.sum(c).over(up_to("_range", *by)).alias(n) for n, c in sums.items()))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*by, "_range").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    before = staged(totals.select(*by, "_range", *(F.sum(f"_{n}").over(earlier).alias(f"_{n}") for n in sums)), "before")
    met = inner.join(before.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_range").alias("_at"), *(f"_{n}" for n in sums)), [*(F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by), F.col("_range") == F.col("_at")])
    return met.select(*df.columns, *((F.col(n) + F.coalesce(F.col(f"_{n}"), F.lit(0))).alias(n) for n in sums))
