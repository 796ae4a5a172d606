from pyspark.sql import functions as F

from specloom.operators import corpus as C


def review(spark, editions, rows):
    std = spark.createDataFrame(editions, "id string, number string, edition_year int")
    null = F.lit(None).cast("string")
    std = std.withColumn("status", F.lit("active")).withColumn("superseded_by", null).withColumn("supersession_source", null)
    return std, spark.createDataFrame(rows, "ordinal long, number string, category string, superseded_by string")


def test_review_makes_no_pairs_of_rows_and_editions(spark):
    """1,000 rows name an edition that 1,000 records hold: a million pairs before, now no join gives more than the records."""
    std, rows = review(spark, [(f"s{i}", "IS 50", 1990) for i in range(1000)] + [("new", "IS 50", 2000)],
                       [(i, "IS 50 : 1990", f"c{i}", "IS 50" if i == 400 else "--") for i in range(1000)])
    parsed, r = C._read_review(std, rows)
    assert (parsed.count(), r.count()) == (1001, 1000)
    out = C.apply_review(std, rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.rindex("Join Inner")
    got = {(x.status, x.superseded_by, x.bis_review_category) for x in out.filter("id <> 'new'").collect()}
    assert got == {("withdrawn", "new", "c999")} and out.filter("id = 'new'").first().status == "active"


def test_review_equals_its_rows_one_by_one(spark):
    std, rows = review(spark, [("a", "IS 50", 1990), ("b", "IS 50", 2000), ("c", "IS 60", 1999), ("d", "IS 50", 2000), ("e", "IS 70 (Part 1)", None)],
                       [(1, "IS 50 : 2000", "x", "IS 60 : 1999"), (2, "IS 50 : 2000", None, "--"), (3, "IS 60", "y", "IS 50 : 1990"),
                        (4, "IS 60 : 1999", "z", "--"), (5, "IS 50 : 1990", "x", "IS 99"), (None, "IS 60", "w", "IS 50"), (6, "IS 70 (Part 1)", "v", "--")])
    last = C.review_outcomes(std, rows).filter("outcome = 'applied'").groupBy("target").agg(
        F.max_by("status", "ordinal").alias("s"), F.max_by("category", "ordinal").alias("c"),
        F.max_by("successor", F.when(F.col("successor").isNotNull(), F.col("ordinal"))).alias("n")).collect()
    want = {r.target: (r.s, r.c, r.n) for r in last if r.s}
    got = {r.id: (r.status, r.bis_review_category, r.superseded_by) for r in C.apply_review(std, rows).collect() if r.status != "active"}
    assert got == want and len(got) == 4
