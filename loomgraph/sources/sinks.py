"""Writers with manifests: digests and counts beside the data, and readers that hold the data against them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digest(*columns: str):
    """An order-free digest of rows: the sum of 60 bits of their SHA-256 in decimal(38)."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    return F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)"))


def manifest(df: DataFrame, by: str) -> DataFrame:
    """by, n and digest of each part."""
    return df.groupBy(by).agg(F.count("*").alias("n"), digest(*sorted(df.columns)).alias("digest"))


def write_parts(df: DataFrame, path: str, by: str) -> None:
    """df as Parquet by part, and its manifest. Nothing is overwritten."""
    df.write.partitionBy(by).parquet(f"{path}/data")
    manifest(df, by).write.parquet(f"{path}/manifest")


def read_parts(spark: SparkSession, path: str, by: str) -> DataFrame:
    """What write_parts wrote; a part that differs from its manifest raises."""
    df = spark.read.parquet(f"{path}/data")
    now, then = manifest(df, by), spark.read.parquet(f"{path}/manifest")
    now = now.withColumn(by, F.col(by).cast(dict(then.dtypes)[by]))
    if now.exceptAll(then).union(then.exceptAll(now)).limit(1).count():
        raise ValueError("a part differs from its manifest")
    return df


def run_id(settings: dict) -> str:
    """Twelve digits that name a run by its settings."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(settings, sort_keys=True, allow_nan=False).encode()).hexdigest()[:12]


def write_folds(df: DataFrame, path: str, fold: str, label: str, leaked: DataFrame) -> None:
    """Candidates by fold with a manifest, and an audit: rows, positives and their share of each fold, and whether it shares a token with another. leaked: (fold, token) of the tokens of each fold."""
    write_parts(df, path, fold)
    shared = leaked.select(fold, "token").distinct().groupBy("token").agg(F.collect_set(fold).alias("folds")).where(F.size("folds") > 1).select(F.explode("folds").alias(fold)).distinct().withColumn("leaks", F.lit(True))  # as many as there are folds
    counts = df.groupBy(fold).agg(F.count("*").alias("n"), F.sum(label).alias("positives"), F.avg(F.col(label).cast("double")).alias("share"))
    counts.join(shared, fold, "left").fillna(False, ["leaks"]).write.parquet(f"{path}/audit")


def write_blocks(df: DataFrame, path: str, by: list[str]) -> None:
    """Predictions as CSV by block, with doubles in their shortest exact form. A path that exists raises: nothing is resumed."""
    df.write.mode("error").partitionBy(*by).csv(path, header=True)


def read_blocks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All blocks that write_blocks wrote, as one table."""
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST")


def write_relations(tables: dict[str, DataFrame], path: str, by: str) -> None:
    """Each relation of a world as a table of its own, by world, with manifests; one without the world's column raises before anything is written."""
    if bad := [k for k, df in tables.items() if by not in df.columns]:
        raise ValueError(f"relations without {by}: {bad}")
    for name, df in tables.items():
        write_parts(df, f"{path}/{name}", by)


def write_scores(metrics: DataFrame, predictions: DataFrame, path: str, keys: tuple[str, str] = ("trial_id", "epoch")) -> None:
    """The metrics and predictions of evaluations, appended by trial and epoch; an evaluation that is there already raises."""
    spark = metrics.sparkSession
    for name, df in (("metrics", metrics), ("predictions", predictions)):
        at = f"{path}/{name}"
        try:
            there = spark.read.parquet(at).select(*keys).distinct()
        except AnalysisException:  # nothing has been written yet
            there = None
        if there is not None and there.join(df.select(*keys).distinct(), list(keys)).limit(1).count():
            raise ValueError(f"an evaluation is written already: {at}")
    for name, df in (("metrics", metrics), ("predictions", predictions)):
        df.write.mode("append").partitionBy(*keys).parquet(f"{path}/{name}")


def write_json(path: str, value) -> None:
    """A small document on the driver: keys in order, no NaN, in place at once or not at all."""
    import json
    import os
    import tempfile

    text = json.dumps(value, sort_keys=True, allow_nan=False, indent=1)
    handle, made = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "w") as f:
        f.write(text)
    os.replace(made, path)
