"""Session helpers shared by every part of the library."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def make_session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings that the library's plans expect."""
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    return SparkSession.builder.master(master).config(map=defaults | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where PYTHONPATH doesn't name it already."""
    sc = spark.sparkContext
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep) + sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, sc.environment.get("PYTHONPATH", "")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, by Spark's own reader so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; a temporary one only where that is unset and everything runs on this machine."""
    sc = spark.sparkContext
    if at := spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if at := sc.getCheckpointDir():
        return at.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomgraph-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder and reads it back. A lost executor then costs a read, not a recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["staged_at"] = path
    return out


def dealt(df: DataFrame, rows: int, *keys: str, most: int = 500_000) -> DataFrame:
    """df dealt by keys to as many tasks as `rows` rows need with about `most` for each, so that a task's memory doesn't grow with the input; never fewer than the session's own number."""
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(own, -(-rows // most)), *keys)


def discard(*frames: DataFrame) -> None:
    """Deletes the tables that staged() wrote for these frames. Nothing that is still to be computed may read them."""
    for df in frames:
        if at := df.__dict__.get("staged_at"):
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
