"""Ranked retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OVERALL = "OVERALL"


def _by_class(per_query: DataFrame, kind: str, aggs: list) -> DataFrame:
    """One row per class and one over all queries, in a single grouping-sets pass."""
    out = per_query.groupingSets([[F.col(kind)], []], F.col(kind)).agg(F.grouping(kind).alias("_all"), *aggs)
    return out.withColumn(kind, F.when(F.col("_all") == 1, F.lit(OVERALL)).otherwise(F.col(kind))).drop("_all")


def first_relevant_rank(queries: DataFrame, hits: DataFrame, qrels: DataFrame, kind: str = "kind") -> DataFrame:
    """(query, kind, first_rank): NULL where no relevant document was returned."""
    good = hits.join(qrels.select("query", "doc").distinct(), ["query", "doc"])
    best = good.groupBy("query").agg(F.min("rank").alias("first_rank"))
    return queries.select("query", kind).join(best, "query", "left")


def ir_metrics(queries: DataFrame, hits: DataFrame, qrels: DataFrame, ks=(1, 3, 5), kind: str = "kind") -> DataFrame:
    """Recall@k (a relevant document is in the first k) and mean reciprocal rank."""
    per_query = first_relevant_rank(queries, hits, qrels, kind)
    recall = [F.round(F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}") for k in ks]
    mrr = F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr")
    return _by_class(per_query, kind, [F.count(F.lit(1)).alias("n"), *recall, mrr])


def ndcg_metrics(queries: DataFrame, hits: DataFrame, gold: DataFrame, ks=(1, 5), kind: str = "kind") -> DataFrame:
    """Success, recall and NDCG at k with one relevant document per query (gain 1/log2(rank+1)).

    With a single relevant document precision means success in the first k, as recall does."""
    per_query = first_relevant_rank(queries, hits, gold, kind)
    aggs = [F.count(F.lit(1)).alias("n")]
    for k in ks:
        inside = F.col("first_rank") <= k
        aggs += [
            F.round(F.avg(F.when(inside, 1.0).otherwise(0.0)), 6).alias(f"precision_{k}"),
            F.round(F.avg(F.when(inside, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}"),
            F.round(F.avg(F.when(inside, F.lit(1.0) / F.log2(F.col("first_rank") + 1)).otherwise(0.0)), 6).alias(f"ndcg_{k}"),
        ]
    return _by_class(per_query, kind, aggs)


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """P@1 of two runs over (query, hit), the standard error of their difference, and whether the
    gap is within two standard errors."""
    rows = a.select(F.lit("a").alias("_s"), "hit").unionByName(b.select(F.lit("b").alias("_s"), "hit"))
    aggs = []
    for s in "ab":
        mine = F.col("_s") == s
        aggs += [F.avg(F.when(mine, F.col("hit").cast("double"))).alias(f"p_{s}"), F.count_if(mine).alias(f"n_{s}")]
    both = rows.agg(*aggs)
    var = [F.col(f"p_{s}") * (1 - F.col(f"p_{s}")) / F.col(f"n_{s}") for s in "ab"]
    se = F.sqrt(var[0] + var[1])
    gap = F.col("p_a") - F.col("p_b")
    return both.select(F.round("p_a", 6).alias("p_a"), F.round("p_b", 6).alias("p_b"), F.round(gap, 6).alias("gap"),
                       F.round(se, 6).alias("se"), (F.abs(gap) < se * 2).alias("within_noise"))
