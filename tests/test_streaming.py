import os

import pytest
from pyspark.sql import functions as F

from loomgraph.streaming import windows

DATA = "/root/testdata/sf0.001/events.parquet"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("events"))
    spark.read.parquet(DATA).repartitionByRange(4, "ts").write.mode("append").parquet(at)
    return at


def test_tumbling(spark, files, tmp_path):
    got = windows.drained(windows.tumbling(windows.event_stream(spark, files, 10), "1 day", "0 seconds"), "tumbled", str(tmp_path), "complete")
    want = spark.read.parquet(DATA).groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert sorted((str(r.start), r.event_type, r.n) for r in got.collect()) == sorted((str(r.start), r.event_type, r.n) for r in want.collect())


def test_sessions_and_copies(spark, files, tmp_path):
    got = windows.drained(windows.sessions(windows.event_stream(spark, files, 10), "1 hour", "0 seconds"), "sessions", str(tmp_path / "a"), "complete")
    assert got.agg(F.sum("n")).first()[0] == 1000
    twice = windows.event_stream(spark, files, 10)
    once = windows.drained(windows.distinct_events(twice.union(windows.event_stream(spark, files, 10)), "40 days"), "once", str(tmp_path / "b"))
    assert once.count() == 1000
