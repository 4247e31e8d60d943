"""Digests of files and arrays, manifests that bind files, and a ledger of stages."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "name string, bytes long, sha256 string"
LEDGER = "run string, stage string, status string, at timestamp, rows long, digest string"


def file_digests(spark: SparkSession, root: str) -> DataFrame:
    """(name, bytes, sha256) of all files below root, on any store that Spark reads; a file is one row of its task, of 2 GB at most."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    sc = spark.sparkContext
    base = sc._jvm.org.apache.hadoop.fs.Path(root)
    store = base.getFileSystem(sc._jsc.hadoopConfiguration())
    top = store.makeQualified(base).toString().rstrip("/")
    found = raw.select(F.substring(F.col("path"), F.lit(len(top) + 2), F.length("path")).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    empty, listed = [], store.listFiles(base, True)  # Spark leaves out files without a byte
    while listed.hasNext():
        f = listed.next()
        if not f.getLen():
            empty.append((f.getPath().toString()[len(top) + 1 :], 0, hashlib.sha256(b"").hexdigest()))
    return found.unionByName(spark.createDataFrame(empty, FILES)) if empty else found


def bind(spark: SparkSession, root: str, path: str) -> None:
    """Writes the digests of all files below root as a table at path, which lies elsewhere. Nothing is overwritten."""
    file_digests(spark, root).write.parquet(path)


def file_faults(spark: SparkSession, root: str, path: str) -> DataFrame:
    """(name, fault) of files that changed, are missing or weren't there when bind() wrote path."""
    now, then = file_digests(spark, root), spark.read.schema(FILES).parquet(path)
    met = then.select("name", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha")).join(now, "name", "full_outer")
    fault = F.when(F.col("_sha").isNull(), "not listed").when(F.col("sha256").isNull(), "missing").when((F.col("sha256") != F.col("_sha")) | (F.col("bytes") != F.col("_bytes")), "changed")
    return met.select("name", fault.alias("fault")).where("fault IS NOT NULL")


def verify_files(spark: SparkSession, root: str, path: str) -> None:
    """Raises if any file below root isn't as bind() found it, or is missing or new."""
    if found := [tuple(r) for r in file_faults(spark, root, path).orderBy("name").limit(5).collect()]:
        raise ValueError(f"files differ from their manifest: {found}")


def array_digest(x: str | Column) -> Column:
    """SHA-256 of an array of numbers as little-endian doubles, in its order; null for null."""

    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        return col.map(lambda v: None if v is None else hashlib.sha256(np.asarray(v, "<f8").tobytes()).hexdigest())

    return run(F.col(x) if isinstance(x, str) else x)


class Ledger:
    """Stages of runs as an appended table: a stage begins once it isn't done, and is done once, with its rows and their digest."""

    def __init__(self, spark: SparkSession, path: str, stages: list[str]):
        self.spark, self.path, self.stages = spark, path, stages

    def entries(self) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(LEDGER).parquet(self.path)
        except AnalysisException:  # nothing has been noted yet
            return self.spark.createDataFrame([], LEDGER)

    def done(self, run: str) -> list[str]:
        """The stages of a run that are done, in order."""
        there = {r.stage for r in self.entries().where((F.col("run") == run) & (F.col("status") == "done")).select("stage").collect()}
        return [s for s in self.stages if s in there]

    def note(self, run: str, stage: str, status: str, rows: int | None, digest: str | None) -> None:
        self.spark.createDataFrame([(run, stage, status, rows, digest)], "run string, stage string, status string, rows long, digest string").withColumn("at", F.current_timestamp()).select(*(c.split()[0] for c in LEDGER.split(", "))).coalesce(1).write.mode("append").parquet(self.path)

    def begin(self, run: str, stage: str) -> None:
        """Notes that a stage begins. A stage that is unknown, done already, or before which another isn't done raises."""
        done = self.done(run)
        if stage not in self.stages or stage in done:
            raise ValueError(f"{stage} can't begin")
        if missing := [s for s in self.stages[: self.stages.index(stage)] if s not in done]:
            raise ValueError(f"{stage} comes after {missing}")
        self.note(run, stage, "begun", None, None)

    def end(self, run: str, stage: str, df: DataFrame) -> None:
        """Notes that a stage is done, with what df holds. One that hasn't begun raises."""
        from loomgraph.sources.sinks import digest

        if not self.entries().where((F.col("run") == run) & (F.col("stage") == stage) & (F.col("status") == "begun")).limit(1).count() or stage in self.done(run):
            raise ValueError(f"{stage} hasn't begun")
        r = df.agg(F.count("*").alias("n"), digest(*sorted(df.columns)).cast("string").alias("d")).first()
        self.note(run, stage, "done", r.n, r.d)

    def verify(self, run: str, stage: str, df: DataFrame) -> None:
        """Raises unless df holds what the stage noted."""
        from loomgraph.sources.sinks import digest

        own = self.entries().where((F.col("run") == run) & (F.col("stage") == stage) & (F.col("status") == "done")).first()
        r = df.agg(F.count("*").alias("n"), digest(*sorted(df.columns)).cast("string").alias("d")).first()
        if own is None or (own.rows, own.digest) != (r.n, r.d):
            raise ValueError(f"{stage} holds other rows than it noted")
