"""Pairs of records and rules or subscribers: each once, and spread over tasks though the keys are few."""

from pyspark.sql import functions as F

from specloom.operators.graph import rules_for
from specloom.operators.reporting import revision_alerts


def tasks_with_rows(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_rules_once_each(spark):
    std = [("a", "IS 1", "x"), ("a", "IS 1", "x"), ("a", "IS 2", "y"), ("b", "IS 2", "x"), ("c", None, "y"), ("d", "IS 1", None)]
    rules = [(1, "IS 1", "y"), (1, None, "x"), (2, None, "x"), (2, None, "x"), (3, "IS 2", None), (4, None, None)]
    want = {(i, r) for i, n, c in std for r, rn, rc in rules if (n == rn if rn else c is not None and c == rc)}
    got = rules_for(spark.createDataFrame(std, "id STRING, number STRING, category STRING"),
                    spark.createDataFrame(rules, "rule_id INT, standard_number STRING, category STRING")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_one_category_takes_many_tasks(spark):
    std = spark.range(400).select(F.concat(F.lit("s"), "id").alias("id"), F.lit("IS 1").alias("number"), F.lit("x").alias("category"))
    rules = spark.range(90).select(F.col("id").alias("rule_id"), F.lit(None).cast("string").alias("standard_number"), F.lit("x").alias("category"))
    out = rules_for(std, rules)
    assert out.count() == out.distinct().count() == 36000 and tasks_with_rows(out) > 4


def test_alerts_once_each_in_many_tasks(spark):
    changes = [("a", "added"), ("a", "changed"), ("a", "added"), ("b", "added")]
    corpus, subs = [("a", "x"), ("a", "y"), ("b", "y"), ("c", "x")], [(1, "x"), (1, "y"), (2, "x"), (2, "x"), (3, "y"), (4, None)]
    want = {(s, i, c) for i, c in changes for j, k in corpus for s, k2 in subs if i == j and k == k2}
    schemas = ("id STRING, change STRING", "id STRING, category STRING", "subscriber INT, category STRING")
    got = revision_alerts(*[spark.createDataFrame(rows, s) for rows, s in zip((changes, corpus, subs), schemas)]).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    std = spark.range(50).select(F.concat(F.lit("s"), "id").alias("id"), F.lit("x").alias("category"))
    many = spark.range(600).select(F.col("id").alias("subscriber"), F.lit("x").alias("category"))
    out = revision_alerts(std.select("id", F.lit("added").alias("change")), std, many)
    assert out.count() == 30000 and tasks_with_rows(out) > 4
