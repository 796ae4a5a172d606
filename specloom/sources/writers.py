"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.operators.bm25 import build_bm25


def overwrite_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Full refresh: the table is replaced as a whole."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    """Append log or audit rows as JSON lines."""
    df.write.mode("append").json(path)


def rebuild_indexes(corpus: DataFrame, edges: DataFrame, vectors: DataFrame, out: str, variant: str = "stop") -> None:
    """Rewrite every store derived from the master table: postings, vectors and edges.

    Edges are clustered by source so that a walk reads few row groups.
    """
    build_bm25(corpus, "doc", "text", variant).write(f"{out}/bm25")
    overwrite_table(vectors, f"{out}/vectors")
    overwrite_table(edges.repartition("source_id").sortWithinPartitions("source_id"), f"{out}/edges")
    overwrite_table(edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")), f"{out}/edge_types")
