"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "specloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators assume (UTC, adaptive plans)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written intermediates.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to a
    folder of this machine; on a cluster a missing setting is an error, because executors could
    not read what another machine wrote.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-specloom-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_written: list[str] = []


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    A lost executor then re-reads the table instead of recomputing the plan, and the optimizer
    knows the table's real size.
    """
    path = new_path(df.sparkSession, "stage")
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession) -> int:
    """Delete the intermediate tables this process wrote; call when their results are stored."""
    n = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n
