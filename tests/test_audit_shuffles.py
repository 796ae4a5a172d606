"""The audit reads a text once a step and shuffles citations once, findings never."""

from pyspark.sql import functions as F

from specloom.functions import numbers as N
from specloom.functions import text as X
from specloom.functions import vocab as V
from specloom.operators import audit as A
from specloom.operators import graph as G


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_filter_on_marks_builds_the_text_once(spark):
    docs = spark.range(3).select(F.col("id").alias("doc"), F.concat(F.lit("ISI mark "), F.col("id").cast("string")).alias("text"))
    assert optimized(docs.filter(X.has_marking("text"))).count("concat(") <= 2  # the filter, and the column if it is kept
    texts = [("a STANDARD Mark", True), ("r-number", True), ("no mark", False), ("", False), (None, None)]
    got = spark.createDataFrame(texts, "text STRING, want BOOLEAN").select(X.has_marking("text").alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_the_bullet_of_an_item_is_cut_once(spark):
    docs = spark.createDataFrame([(1, "1. Steel bars\r\n\r\n\r - copper wire\t\x0b(a) xy plain line\n\r\n")], ["doc", "text"])
    text, items = docs.first().text, N.line_items(docs, "doc", "text")
    assert optimized(items.filter(~F.col("item").rlike("zzz"))).count(V.BULLET_PREFIX) == 1
    rows = items.collect()
    assert [(r.item, text[r.start:r.end]) for r in rows] == [(x, x) for x in ("Steel bars", "copper wire", "plain line")]


def test_findings_are_not_shuffled(spark):
    docs = spark.createDataFrame([(f"d{i}", f"Supply IS 10:1990 and IS 10:200{i % 3} and IS 7{i}.\n- copper cable drum") for i in range(9)], ["doc", "text"])
    rows = [("old", "IS 10:1990", 1990, "superseded", None, None, None, None), ("new", "IS 10:2001", 2001, "active", "ISI", True, None, "Q1"),
            ("p", "IS 20", 2000, "active", None, None, None, None)]
    std = spark.createDataFrame(rows, "id STRING, number STRING, edition_year INT, status STRING, scheme STRING, mandatory BOOLEAN, qco_checked BOOLEAN, order_id STRING")
    std = std.withColumn("supersession_source", F.lit("curated"))
    edges = spark.createDataFrame([("new", "p", "R"), ("new", "old", "R"), ("old", "p", "R")], ["source_id", "target_id", "type"])
    chain = G.resolve_chain(std.select("id", "status"), spark.createDataFrame([("old", "new")], ["id", "successor"]))
    hits = spark.createDataFrame([("copper cable drum", "p", 0.6)], ["item", "standard_id", "similarity"])
    found = A.lint(docs, std, edges, spark.createDataFrame([("Q1", "One")], ["order_id", "order_name"]), chain, hits, ["R"], 0.45, ordered=True)
    plan = found.groupBy("doc").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    level = {"high": 0, "medium": 1, "low": 2}
    got = found.filter("doc = 'd1'").collect()
    places = [(level[r.severity], r.start is None, r.start, r.rule_id) for r in got]
    assert places == sorted(places, key=lambda p: (p[0], p[1], p[2] or 0, p[3])) and len({r.doc for r in got}) == 1
    assert sorted(r.rule_id for r in got) == ["certification_unverified", "missing_allied_standard", "missing_allied_standard",
                                              "missing_certification_requirement", "superseded_citation", "uncited_item", "unresolved_citation"]
