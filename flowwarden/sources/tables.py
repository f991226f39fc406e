"""Versioned snapshots, append logs and vector collections on a shared file system."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _versions(spark: SparkSession, path: str) -> list[int]:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = []
    for entry in fs.listStatus(root):
        name = entry.getPath().getName()
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
        if name.startswith("version=") and fs.exists(done):
            found.append(int(name.split("=", 1)[1]))
    return sorted(found)


def write_snapshot(df: DataFrame, path: str, version: int) -> None:
    """One folder per version. A retried batch rewrites its own folder; a half-written one is ignored."""
    df.write.mode("overwrite").parquet(f"{path}/version={version}")


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """Newest complete version, or the newest below `before`; an empty table when there is none."""
    versions = [v for v in _versions(spark, path) if before is None or v < before]
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/version={versions[-1]}")


def append_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Log partition of one batch; rewriting it makes a retry harmless."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All batches of a log; a missing log is an empty one."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_json_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON-lines log in which an unreadable record is skipped rather than fatal."""
    with_bad = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(with_bad).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    return rows.filter(F.col("_bad").isNull()).drop("_bad")


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").partitionBy("collection").parquet(path)


def read_vectors(spark: SparkSession, path: str, schema: T.StructType, collection: str | None = None) -> DataFrame:
    """Vector table; naming a collection prunes to its partition."""
    rows = read_log(spark, path, schema)
    return rows if collection is None else rows.filter(F.col("collection") == collection)
