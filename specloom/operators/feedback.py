"""Interaction logs: acceptance rates, labels, integrity, synthetic logs, splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.functions.text import _col
from specloom.operators.ranking import exact_rank, topk

# Interaction rows: query, candidates_shown array<struct<id, final_score, rank>>, chosen_id, action,
# corrected_id, timestamp, source.


def shown(logs: DataFrame) -> DataFrame:
    return logs.select(F.explode("candidates_shown").alias("c")).select(F.col("c.id").alias("id")).filter(F.col("id").isNotNull())


def selected(action="action", chosen="chosen_id", corrected="corrected_id") -> Column:
    """The record an interaction ended on, NULL for a rejection."""
    return F.when(_col(action) == "accept", _col(chosen)).when(_col(action) == "correct", _col(corrected))


def acceptance_rate(logs: DataFrame) -> DataFrame:
    """(id, n_shown, n_accepted, rate) for every record that was shown.

    A record that was only ever corrected to has no row (its rate is 0), and a rate can exceed 1.
    """
    s = shown(logs).groupBy("id").agg(F.count(F.lit(1)).alias("n_shown"))
    a = logs.select(selected().alias("id")).filter(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("n_accepted"))
    return s.join(a, "id", "left").fillna(0, ["n_accepted"]).withColumn("rate", F.col("n_accepted") / F.col("n_shown"))


def feedback_labels(logs: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query, id, label): 1 where a query's user ended on the record, 0 where it was only rejected."""
    good = logs.select("query", selected().alias("id"), F.lit(1).alias("label")).filter(F.col("id").isNotNull())
    bad = logs.filter(F.col("action") == "reject").select("query", F.explode("candidates_shown.id").alias("id")).filter(
        F.col("id").isNotNull()).withColumn("label", F.lit(0))
    best = good.unionByName(bad).groupBy("query", "id").agg(F.max("label").alias("label"))
    return best.join(corpus.select("id").distinct(), "id", "left_semi")


def leakage(logs: DataFrame, eval_queries: DataFrame) -> DataFrame:
    """Distinct training queries that also occur in the evaluation set (after trimming)."""
    q = logs.select(F.trim("query").alias("query")).distinct()
    return q.join(eval_queries.select(F.trim("query").alias("query")), "query", "left_semi")


def outside_training(logs: DataFrame, train_queries: DataFrame) -> DataFrame:
    q = logs.select(F.trim("query").alias("query")).distinct()
    return q.join(train_queries.select(F.trim("query").alias("query")), "query", "left_anti")


def log_integrity(logs: DataFrame, train: DataFrame, evaluation: DataFrame, expected: int) -> DataFrame:
    """One row: (n_lines, n_leaked, n_extra, passed)."""
    parts = [logs.select(F.lit("lines").alias("k")), leakage(logs, evaluation).select(F.lit("leaked").alias("k")),
             outside_training(logs, train).select(F.lit("extra").alias("k"))]
    n = [F.count_if(F.col("k") == k).alias(f"n_{k}") for k in ("lines", "leaked", "extra")]
    one = reduce(DataFrame.unionByName, parts).agg(*n)
    return one.withColumn("passed", (F.col("n_lines") == expected) & (F.col("n_leaked") == 0) & (F.col("n_extra") == 0))


def synth_interactions(hits: DataFrame, gold: DataFrame, noise: float, seed: int) -> DataFrame:
    """Synthetic logs from result lists: (query, chosen_id, action, candidates_shown, source).

    Each query accepts its gold record, or with probability ``noise`` another of the top five, and
    rejects one or two of the others. ``hits(query, doc, score, rank)`` are the top ten; draws come
    from hashes of query and record, so a rerun repeats them.
    """
    def draw(*salt) -> Column:
        return F.pmod(F.xxhash64(*[_col(s) if isinstance(s, str) else s for s in salt], F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0

    h = hits.filter("rank <= 10").join(gold.select("query", F.col("doc").alias("gold")), "query")
    h = h.withColumn("_other", F.when((F.col("rank") <= 5) & (F.col("doc") != F.col("gold")), draw("query", "doc")))
    per = h.groupBy("query").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("doc").alias("id"), F.col("score").alias("final_score")))).alias("_c"),  # ten rows
        F.max(F.when(F.col("doc") == F.col("gold"), F.col("doc"))).alias("_hit"), F.min_by("doc", "rank").alias("_top"),
        F.min_by("doc", "_other").alias("_wrong"))
    noisy = (draw("query", F.lit("noise")) < noise) & F.col("_wrong").isNotNull()
    chosen = F.when(noisy, F.col("_wrong")).otherwise(F.coalesce("_hit", "_top"))
    cands = F.transform("_c", lambda c: F.struct(c["id"].alias("id"), c["final_score"].alias("final_score"), c["rank"].alias("rank")))
    accept = per.select("query", chosen.alias("chosen_id"), F.lit("accept").alias("action"), cands.alias("candidates_shown"))
    others = h.join(accept.select("query", "chosen_id"), "query").filter((F.col("rank") <= 5) & (F.col("doc") != F.col("chosen_id")))
    others = others.withColumn("_d", draw("query", "doc", F.lit("reject")))
    picked = topk(others, ["query"], ["_d", "doc"], 2, "_n").filter((F.col("_n") == 1) | (draw("query", F.lit("two")) < 0.5))
    reject = picked.select("query", F.lit(None).cast(accept.schema["chosen_id"].dataType).alias("chosen_id"), F.lit("reject").alias("action"),
                           F.array(F.struct(F.col("doc").alias("id"), F.col("score").alias("final_score"), "rank")).alias("candidates_shown"))
    return accept.unionByName(reject).withColumn("source", F.lit("synthetic"))


def hash_order(key: str, seed: int) -> Column:
    return F.xxhash64(F.col(key), F.lit(seed))


def stratified_sample(df: DataFrame, by: str, key: str, n: int, seed: int) -> DataFrame:
    """The first ``n`` rows of every stratum in a seeded hash order (repeatable on any layout)."""
    return topk(df.withColumn("_h", hash_order(key, seed)), [by], ["_h", key], n, "_n").drop("_h", "_n")


def kfold(df: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """Add ``fold``: whole groups are dealt to ``k`` folds of equal size in hash order."""
    groups = df.select(group).distinct().withColumn("_h", hash_order(group, seed))
    ranked = exact_rank(groups, [], ["_h", group], "_n")
    return df.join(ranked.select(group, F.pmod(F.col("_n") - 1, F.lit(k)).cast("int").alias("fold")), group)


def group_split(df: DataFrame, group: str, ratio: float, seed: int) -> DataFrame:
    """Add ``part``: the first ``ratio`` of the groups in hash order are validation, at least one."""
    groups = df.select(group).distinct().withColumn("_h", hash_order(group, seed))
    ranked = exact_rank(groups, [], ["_h", group], "_n")
    n = groups.agg(F.count(F.lit(1)).alias("n")).select(F.greatest(F.lit(1), F.round(F.col("n") * ratio)).alias("c")).scalar()
    return df.join(ranked.select(group, F.when(F.col("_n") <= n, "validation").otherwise("train").alias("part")), group)


def build_eval_set(corpus: DataFrame, size: int, seed: int, sector: str = "category", key: str = "id", title: str = "title",
                   train_share: float = 0.6) -> DataFrame:
    """(query, correct_id, category, part): queries from a stratified sample, split 60/40 by order."""
    from specloom.functions.text import query_from_title
    sectors = max(1, corpus.select(sector).distinct().count())
    sample = stratified_sample(corpus, sector, key, max(1, size // sectors), seed)
    made = sample.select(query_from_title(title, key).alias("query"), F.col(key).alias("correct_id"), F.col(sector).alias("category")).filter("query <> ''")
    ranked = exact_rank(made.withColumn("_h", hash_order("correct_id", seed + 1)), [], ["_h", "correct_id"], "_n")
    kept = ranked.filter(F.col("_n") <= size)
    n = made.agg(F.least(F.lit(size), F.count(F.lit(1))).alias("n")).select(F.floor(F.col("n") * train_share).alias("c")).scalar()
    return kept.select("query", "correct_id", "category", F.when(F.col("_n") <= n, "train").otherwise("eval").alias("part"))


def recent(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last ``n`` rows, newest first (a top-n, never a full sort)."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)
