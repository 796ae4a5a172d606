"""Helpers shared by the training-data operators: typed columns, text slices, running sums, components."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specloom.session import new_path

#: Text that one Python step works on at once, in characters. A longer document is a step of its own.
SLICE_CHARS = 300_000


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table."""
    path = shared_path(df.sparkSession, "stage")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    return new_path(spark, name)


def fold_of(doc_id: str, folds: int) -> Column:
    """``crc32(doc_id as text) mod folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """One long per (id, text). Repeated rows share it, and every operator gives them equal results."""
    return F.xxhash64(F.col(doc_id).cast("string"), F.lit("|"), F.col(text), F.col(text).isNull())


def slices(lengths: Sequence[int], limit: int = SLICE_CHARS) -> Iterator[slice]:
    """Consecutive slices whose lengths sum to about ``limit`` at most; a longer item stands alone."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield slice(start, len(lengths))


@contextmanager
def rows_a_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Actions inside send Arrow batches of at most ``rows`` rows: a bound on memory where rows are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def release_memory() -> None:
    """Give what a finished task held back to the machine; a Python worker goes on to tasks of other stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def unit_hash(*cols) -> Column:
    """A number in [0, 1) that depends on the given columns alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over all earlier rows of the group, without a group in one task.

    Rows are dealt by ranges of (group, order), summed inside a range, and shifted by what the
    group has in earlier ranges. The per-range totals are one row for each range and group in it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *by, *order).withColumn("_range", F.spark_partition_id()))
    groups = [*by, "_range"]
    totals = ranged.groupBy(*groups).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(groups)], F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = F.lit(True)
    for i, c in enumerate(groups):
        same = same & local[c].eqNullSafe(shift[f"_k{i}"])
    return local.join(shift, same).select(*[local[c] for c in df.columns], (F.col("_inside") + F.col("_shift")).alias(out))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b longs): rows (node, root), root the smallest node reachable.

    Alternating large-star and small-star steps: every step is one shuffle by node, replaces links
    by links to the smallest neighbour, never makes more links than it got, and ends in stars.
    Each step is written to the shared folder, so a lost executor repeats one step at most. Only the
    number and a hash of the links come to the driver.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())

    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = state(links)
    for _ in range(rounds):
        if not seen[0]:
            break
        around = both(links)
        low = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        links = cut(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = state(links)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = links.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return stars.unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def as_u64(values) -> np.ndarray:
    return np.asarray(values, dtype=np.int64).view(np.uint64)
