"""The relations that the queries work on, from the test tables, and the same relations in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import table

def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, src, dst, hours, amount, kind, world: an arc from a user to the number in the event's properties. A world is a day; an account of one is another account in the next."""
    hours = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("src"), F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("bigint").alias("dst"), hours.cast("bigint").alias("hours"), F.col("value").alias("amount"), F.col("event_type").alias("kind"), F.floor(hours / 24).cast("bigint").alias("world"))


TRANSFERS = """t AS (SELECT event_id, user_id AS src, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS dst,
 CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hours, value AS amount, event_type AS kind, CAST(floor(floor(epoch(ts) / 3600) / 24) AS BIGINT) AS world FROM events)"""
#: The arcs of each world.
ARCS = f"{TRANSFERS}, a AS (SELECT world, src, dst, count(*) AS m FROM t WHERE src <> dst GROUP BY ALL)"


def nation_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, m): lines sold from customers' nations to suppliers' nations."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey", "s_nationkey").agg(F.count("*").alias("n"))
    buyers = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    return lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.sum("n").alias("m"))


NATION_ARCS = """g AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS m FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
 JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """world, candidate, y, s: labelled documents with their length as the score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("world"), F.col("n_chars").cast("double").alias("s"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select("world", F.col("doc_id").alias("candidate"), F.col("toxic").alias("y"), "s", "quality")


SCORED = "z AS (SELECT source AS world, doc_id AS candidate, toxic AS y, CAST(n_chars AS DOUBLE) AS s, quality FROM documents JOIN labels USING (doc_id))"
