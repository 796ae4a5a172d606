"""Versioned tables: one folder per batch, so a replay overwrites exactly what it wrote before."""

from __future__ import annotations

import contextlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_version(df: DataFrame, path: str, version: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/version={version}")


def latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest version (below ``before``), or None; only that version's files are read."""
    versions = []
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hadoop):
        for status in fs.listStatus(hadoop):
            name = status.getPath().getName()
            done = fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS"))
            if name.startswith("version=") and done:
                versions.append(int(name.split("=")[1]))
    versions = [v for v in versions if before is None or v < before]
    if not versions:
        return None
    with contextlib.suppress(AnalysisException):
        return spark.read.parquet(f"{path}/version={max(versions)}")
    return None


def all_versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("version", F.col("version").cast("bigint"))
