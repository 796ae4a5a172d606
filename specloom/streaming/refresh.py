"""Streams of documents: continuous audit and incremental corpus refresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from specloom.operators.ranking import first_per_group
from specloom.operators import corpus as C
from specloom.streaming.versions import latest, write_version


def stream_documents(spark: SparkSession, path: str, schema: str = "doc STRING, text STRING") -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def stream_lint(docs: DataFrame, audit: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Audit new documents against static tables; the findings of one batch are one version of ``out``."""
    def run(batch: DataFrame, batch_id: int) -> None:
        write_version(audit(batch), out, batch_id)

    return docs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incremental_refresh(records: DataFrame, state: str, checkpoint: str, document_fields: list[str], defaults: dict[str, Column],
                        hashed: list[str], text: str, model: str) -> StreamingQuery:
    """Merge arriving records into a versioned master table and list what has to be indexed again.

    Per batch, under ``state``: ``master`` (the merged corpus), ``changes`` (added, changed ids) and
    ``embed`` (keys of rows whose text has no vector yet). Only those rows are re-indexed.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = first_per_group(batch, ["id"], batch.columns)  # the same row on any layout
        old = latest(spark, f"{state}/master", before=batch_id)
        if old is None:
            empty = spark.createDataFrame([], batch.schema)
            for name, default in defaults.items():
                empty = empty.withColumn(name, default)
            old = empty
        merged = C.merge_records(old, newest, document_fields, defaults).drop("change")
        write_version(merged, f"{state}/master", batch_id)
        written = latest(spark, f"{state}/master", before=batch_id + 1)
        diff = C.snapshot_diff(C.snapshot(written, "id", hashed), C.snapshot(old, "id", hashed))
        write_version(diff, f"{state}/changes", batch_id)
        cached = C.needs_embedding(old, text, model, written.sparkSession.createDataFrame([], "cache_key STRING")).select("cache_key")
        write_version(C.needs_embedding(written, text, model, cached).select("id", "cache_key"), f"{state}/embed", batch_id)

    return records.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
