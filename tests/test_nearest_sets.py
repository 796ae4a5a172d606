"""Similar scopes are found by comparing blocks of sets; no row is made for a pair."""

import random

from pyspark.sql import functions as F

from specloom.operators import overlap as O


def brute(sets, threshold, top):
    best = {}
    for a, x in sets.items():
        near = [(-round(len(x & y) / len(x | y), 9), b) for b, y in sets.items() if a != b and len(x & y) / len(x | y) >= threshold]
        best |= {(a, b): (-s, i + 1) for i, (s, b) in enumerate(sorted(near)[:top])}
    return best


def test_many_like_scopes_make_no_row_for_a_pair(spark):
    rnd = random.Random(5)
    texts = {i: " ".join(rnd.sample([f"w{j}" for j in range(40)], rnd.randint(14, 30))) for i in range(400)}
    docs = spark.createDataFrame(list(texts.items()), "id long, scope string")
    made, cut = [], O.cut_lineage

    def counting(df):
        out = cut(df)
        made.append(out.count())
        return out

    O.cut_lineage = counting
    try:
        got = {(r.id, r.other): (r.overlap, r.rank) for r in O.scope_overlap(docs, 0.5, 3).collect()}
    finally:
        O.cut_lineage = cut
    want = brute({i: frozenset(t.split()) for i, t in texts.items()}, 0.5, 3)
    assert len(want) > 300 and got == want
    assert max(made) <= 400 * 3 * 16  # what a set keeps of each block; before, 79,800 pairs less those that the filters left out


def test_blocks_and_tiles_of_any_size_give_the_same(spark):
    rnd = random.Random(6)
    sets = {f"k{i}": frozenset(rnd.sample(range(60), rnd.randint(1, 40))) for i in range(150)}
    rows = spark.createDataFrame([(k, len(v), sorted(v)) for k, v in sets.items()], "key string, n int, words array<long>")
    want = {(a, b) for a, b in brute(sets, 0.4, 4)}
    for how in ({"block": 10, "tile": 4}, {"block": 40, "tile": 1024}, {"least_blocks": 1, "tile": 7}):
        near = O.nearest_sets(rows, 0.4, 4, **how)
        overlap = F.round(F.col("both") / (F.col("n") + F.col("m") - F.col("both")), 9)
        got = O.topk(near.select("id", "other", overlap.alias("o")), ["id"], ["-o", "other"], 4)
        assert {(r.id, r.other) for r in got.collect()} == want
