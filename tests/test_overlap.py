"""Scope overlap and dispute lift against all pairs."""

import random
from itertools import combinations

import pytest

from specloom.operators.overlap import dispute_lift, scope_overlap


@pytest.mark.parametrize("threshold,top", [(0.5, 3), (0.8, 50), (1.0, 5), (0.1, 1000)])
def test_overlap_equals_all_pairs(spark, threshold, top):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[min(59, int(rng.expovariate(0.06)))] for _ in range(rng.randint(1, 14)))) for i in range(120)]
    rows += [(200 + i, rows[i % 5][1]) for i in range(40)] + [(300, None), (301, ""), (302, "?!"), (303, "W1 w1"), (304, "w1")]
    sets = {}
    for i, t in rows:
        found = frozenset((t or "").lower().split()) - {"?!"}
        if found:
            sets[found] = min(i, sets.get(found, i))
    lists = {}
    for (a, i), (b, j) in combinations(sets.items(), 2):
        s = round(len(a & b) / len(a | b), 9)
        if s >= threshold:
            lists.setdefault(i, []).append((-s, j))
            lists.setdefault(j, []).append((-s, i))
    want = {(i, j, -s, r) for i, x in lists.items() for r, (s, j) in enumerate(sorted(x)[:top], 1)}
    got = scope_overlap(spark.createDataFrame(rows, "id long, scope string"), threshold, top).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_only_prefixes_are_joined(spark, monkeypatch):
    """A word in every scope is joined nowhere: rows follow the results, not the square of the scopes."""
    import specloom.operators.overlap as O

    rows = [(i, " ".join(["common", "shared", *(f"r{i}x{j}" for j in range(8))])) for i in range(300)]
    sizes, cut = [], O.cut_lineage
    monkeypatch.setattr(O, "cut_lineage", lambda df: (out := cut(df), sizes.append((out.columns, out.count())))[0])
    assert scope_overlap(spark.createDataFrame(rows, "id long, scope string"), 0.5).count() == 0
    assert dict((tuple(c), n) for c, n in sizes)["a", "b"] == 0


def test_lift_of_records_and_pairs(spark):
    rng = random.Random(8)
    cites = [(d, rng.randint(1, 6)) for d in range(80) for _ in range(rng.randint(0, 5))] + [(1, None), (999, 3)]
    outcomes = [(d, rng.random() < 0.4) for d in range(70)] + [(70, None), (5, True)]
    bad = {}
    for d, b in outcomes:
        if b is not None:
            bad[d] = max(bad.get(d, False), b)
    base, docs = sum(bad.values()) / len(bad), {}
    for d, r in cites:
        if d in bad and r is not None:
            docs.setdefault((r, None), set()).add(d)
    for (a, _), (b, _) in combinations(sorted(docs), 2):
        docs[a, b] = docs[a, None] & docs[b, None]
    want = {(*k, len(v), sum(bad[d] for d in v), round(sum(bad[d] for d in v) / len(v) / base, 6)) for k, v in docs.items() if len(v) >= 4}
    got = dispute_lift(spark.createDataFrame(cites, "doc long, record long"), spark.createDataFrame(outcomes, "doc long, bad boolean"), 4).collect()
    assert {tuple(r) for r in got} == want and any(r["second"] for r in got)
    assert dispute_lift(spark.createDataFrame([], "doc long, record long"), spark.createDataFrame([], "doc long, bad boolean")).collect() == []


def test_no_pair_carries_its_words(spark):
    """Every pair of blocks, and sets that are in many pairs, against plain sets; the words meet the pairs in one shuffle."""
    from specloom.operators.overlap import shared_words

    rng = random.Random(4)
    sets = {f"k{i}": sorted(rng.sample(range(40), rng.randint(1, 12))) for i in range(50)}
    pairs = [(a, b) for a, b in combinations(sorted(sets), 2) if rng.random() < 0.7]
    out = shared_words(spark.createDataFrame(pairs, "a string, b string"), spark.createDataFrame(list(sets.items()), "key string, words array<long>"), 9)
    want = {(a, b, len(sets[a]), len(sets[b]), len(set(sets[a]) & set(sets[b]))) for a, b in pairs}
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
