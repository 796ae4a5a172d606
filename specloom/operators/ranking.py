"""Ranks, top-k and per-group statistics that stay exact when one group holds most rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specloom.session import cut_lineage


def ordering(*keys: str) -> list[Column]:
    """``"-score"`` is descending with nulls last, ``"id"`` ascending."""
    return [F.col(k[1:]).desc_nulls_last() if k.startswith("-") else F.col(k).asc() for k in keys]


def topk(df: DataFrame, by: Sequence[str], order: Sequence[str], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group, numbered from 1.

    The ``rank <= k`` filter lets Spark prune inside each map task (WindowGroupLimit), so a hot
    group sends at most ``k`` rows per task through the shuffle.
    """
    window = Window.partitionBy(*by).orderBy(*ordering(*order))
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def first_per_group(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    return topk(df, by, order, 1, "_first").drop("_first")


def exact_rank(df: DataFrame, by: Sequence[str], order: Sequence[str], rank: str = "rank") -> DataFrame:
    """Row number of every row in its group, without putting a whole group into one task.

    Rows are range-partitioned by (group, order), written once, numbered inside each range, and
    shifted by the number of rows the same group has in earlier ranges. ``order`` must end in a
    unique key.
    """
    by = list(by)
    sort = [F.col(c).asc() for c in by] + ordering(*order)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(parts, *sort).withColumn("_range", F.spark_partition_id()))
    groups = [*by, "_range"]
    counts = ranged.groupBy(*groups).count()
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*groups, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*groups).orderBy(*ordering(*order))
    numbered = ranged.withColumn("_inside", F.row_number().over(inside))
    left, right = numbered.alias("l"), offsets.alias("r")
    match = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in groups]
    condition = match[0]
    for m in match[1:]:
        condition = condition & m
    joined = left.join(right, condition)
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns],
        (F.col("_inside") + F.col("_offset")).cast("bigint").alias(rank),
    )


def with_group_stats(df: DataFrame, by: Sequence[str], **stats: Column) -> DataFrame:
    """Attach group aggregates by aggregate-and-join: partial sums before the shuffle, no window."""
    return df.join(df.groupBy(*by).agg(*[c.alias(n) for n, c in stats.items()]), list(by))


def minmax(df: DataFrame, by: Sequence[str], col: str, out: str) -> DataFrame:
    """Min-max scaling inside each result list (already cut to its top rows, so a list is short);
    a range of at most 1e-6 gives 0.5."""
    window = Window.partitionBy(*by)
    lo, hi = F.min(col).over(window), F.max(col).over(window)
    return df.withColumn(out, F.when(hi - lo > 1e-6, (F.col(col) - lo) / (hi - lo + 1e-6)).otherwise(F.lit(0.5)))


def maxnorm(df: DataFrame, by: Sequence[str], col: str, out: str) -> DataFrame:
    """Score divided by the best of its (short) result list; a best of at most 0 divides by 1."""
    top = F.max(col).over(Window.partitionBy(*by))
    return df.withColumn(out, F.col(col) / F.when(top > 0, top).otherwise(F.lit(1.0)))


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread: str, salts: int = 8) -> DataFrame:
    """Inner join whose hot keys are split: ``big`` rows are spread over ``salts`` by the hash of
    ``spread`` and every ``small`` row is repeated once per salt."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"]).drop("_salt")


def spread_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread: str, salts: int = 16) -> DataFrame:
    """``salted_join`` for few keys of which each makes very many pairs. The number of tasks is fixed, because the size of
    their input, by which adaptive execution merges tasks, says nothing about their output."""
    spark = big.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).repartition(n, *on, "_salt")
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).repartition(n, *on, "_salt")
    return left.join(right, [*on, "_salt"]).drop("_salt")


def tasks_for(spark: SparkSession, rows: int, per_task: int = 500_000) -> int:
    """Partitions for ``rows``, so that a task's rows do not grow with the table. (Adaptive execution merges tasks by their compressed
    bytes and makes no more of them than ``spark.sql.shuffle.partitions``.)"""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / per_task))


def alone(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The distinct rows whose ``by`` occurs once, and the others."""
    counted = df.distinct().withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    return counted.filter("_n = 1").drop("_n"), counted.filter("_n > 1").drop("_n")


def distinct_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def spread(scan: DataFrame, key: str) -> DataFrame:
    """A table scan with at least one partition per core, for text work that costs far more than a row.

    A scan that is already split into enough tasks (any large table) is returned as it is; only a
    table stored in fewer row groups than there are cores is hashed over them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, key)
