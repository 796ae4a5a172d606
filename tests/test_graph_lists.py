import random

from pyspark.sql import functions as F

from specloom.operators import graph as G
from specloom.operators.ranking import tasks_for


def edges_of(spark, rows):
    return spark.createDataFrame(rows, ["source_id", "target_id", "type"])


def test_names_come_back_from_joined_strings(spark):
    names = ["a", "", None, "\x00", "\x01", "\x01a", "\x01n", "b\x00\x01b", "é"]
    df = spark.createDataFrame([(names,)], "n array<string>").select(G.joined(F.col("n")).alias("t"))
    assert df.select(G.parted(F.col("t")).alias("n")).first()["n"] == names


def test_large_requests_give_the_same_nodes_and_edges(spark):
    """With a bound of 40 candidates some requests take the second way; a hub fills several lists."""
    rng = random.Random(5)
    rows = sorted({(f"n{rng.randint(0, 25)}", f"n{rng.randint(0, 25)}", rng.choice(["RELATED_PRODUCT", "AMENDED_BY"])) for _ in range(60)})
    rows += [("hub", f"m{i}", "RELATED_PRODUCT") for i in range(1500)] + [("n1", "hub", "AMENDED_BY")]
    steps = G.orient(edges_of(spark, rows))
    seeds = spark.createDataFrame([(f"r{i}", f"n{i}") for i in range(6)] + [("r0", "n9"), ("rh", "hub")], ["request", "node"])
    one, two = ([tuple(map(str, r)) for r in G.expand(seeds, steps, 3, most).collect()] for most in (4_000_000, 40))
    assert len(one) > 3000 and sorted(one) == sorted(two)


def test_last_hop_is_not_shuffled_by_candidate(spark):
    """Candidates are spread out behind the shuffle: a row of a list moves, not a row of a step."""
    star = edges_of(spark, [("c", f"m{i}", "AMENDED_BY") for i in range(1000)] + [(f"s{i}", "c", "AMENDED_BY") for i in range(5)])
    steps = G.neighbour_lists(G.orient(star))
    front = spark.createDataFrame([(f"s{i}", [f"s{i}", "c"]) for i in range(5)], "request string, path array<string>")
    [met] = G.candidates(front, steps, front.select("request", F.col("request").alias("node")))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange") and met.count() == 5005


def test_tasks_grow_with_rows(spark):
    assert [tasks_for(spark, n) for n in (0, 2_000_000, 50_000_000)] == [4, 4, 100]


def test_edges_in_both_directions_scan_them_once(spark, tmp_path):
    edges_of(spark, [("a", "b", "x"), ("b", "c", "y")]).write.parquet(f"{tmp_path}/e")
    ways = G.both_ways(spark.read.parquet(f"{tmp_path}/e"))
    assert ways._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    ids = spark.createDataFrame([("b",), ("b",)], ["id"])
    got = {tuple(r) for r in G.incident_edges(ids, spark.read.parquet(f"{tmp_path}/e")).select("id", "other", "type", "direction").collect()}
    assert got == {("b", "a", "x", "inverse"), ("b", "c", "y", "forward")}
