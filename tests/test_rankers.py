"""LambdaRank against brute force and the pointwise ranker; contributions of boosted trees against the score."""

import math
import random

import numpy as np
import pytest

from specloom.operators import ranker as L
from specloom.operators.ranking import topk

NAMES = ["a", "b", "c"]


def test_gradients_equal_numeric_ones_of_every_pair():
    rng = np.random.default_rng(1)
    x, labels, w = rng.normal(size=(7, 3)), np.array([0, 3, 1, 0, 1, 0, 3.0]), rng.normal(size=3)
    scores = x @ w
    order = sorted(range(7), key=lambda i: -scores[i])
    place = {d: r for r, d in enumerate(order)}
    ideal = sum((2 ** g - 1) / math.log2(r + 2) for r, g in enumerate(sorted(labels, reverse=True)))

    def weight(i, j):  # NDCG with the two swapped
        def dcg(p):
            return sum((2 ** labels[d] - 1) / math.log2(p[d] + 2) for d in range(7)) / ideal
        swapped = {**place, i: place[j], j: place[i]}
        return abs(dcg(swapped) - dcg(place))

    pairs = [(i, j, weight(i, j)) for i in range(7) for j in range(7) if labels[i] > labels[j]]
    loss = lambda v: sum(c * math.log(1 + math.exp(-(x[i] - x[j]) @ v)) for i, j, c in pairs)
    gradient, curve = L.lambda_gradients(x, labels, scores)
    e = 1e-4
    for f in range(3):
        d = np.eye(3)[f] * e
        assert gradient[f] == pytest.approx((loss(w + d) - loss(w - d)) / (2 * e), abs=1e-6)
        assert curve[f, f] == pytest.approx((loss(w + d) - 2 * loss(w) + loss(w - d)) / e ** 2, abs=1e-3)
    assert not L.lambda_gradients(x, np.zeros(7), scores)[0].any()


@pytest.fixture(scope="module")
def planted(spark):
    """Within a query feature a orders the documents. Feature b is as large as the query is easy, so it follows the label between queries
    and misleads inside them; a least-squares fit over all rows leans on it."""
    rng = random.Random(3)
    rows = []
    for q in range(60):
        easy = rng.random() < 0.5
        for d in range(20):
            label = 3 if d == 0 else rng.choice([0, 0, 0, 3 if easy else 0, 1])
            a = 0.25 * label + rng.gauss(0, 0.35)
            b = (5.0 if easy else 0.0) - (0.8 * label if easy else 0) + rng.gauss(0, 0.5)
            rows.append((q, 100 * q + (d * 7) % 20, label, a, b, rng.gauss(0, 1)))
    return spark.createDataFrame(rows, "query long, doc long, label int, a double, b double, c double").cache()


def ndcg5(scored):
    lists = {}
    for r in scored.select("query", "doc", "label", "score").collect():
        lists.setdefault(r["query"], []).append((-r["score"], r["doc"], r["label"]))
    out = []
    for rows in lists.values():
        gain = [2 ** x - 1 for _, _, x in sorted(rows)]
        best = sum(g / math.log2(i + 2) for i, g in enumerate(sorted(gain, reverse=True)[:5]))
        out.append(sum(g / math.log2(i + 2) for i, g in enumerate(gain[:5])) / best)
    return sum(out) / len(out)


def test_listwise_ranks_better_than_pointwise_on_unseen_queries(planted):
    train, held = planted.filter("query % 3 <> 0"), planted.filter("query % 3 = 0")
    got = {kind: ndcg5(L.score_ranker(L.train_ranker(train, kind, NAMES), held, NAMES)) for kind in ("linear", "listwise")}
    assert got["listwise"] > got["linear"] + 0.02, got
    with pytest.raises(Exception, match="candidate pool"):
        L.train_listwise(train, NAMES, most=5)


@pytest.mark.parametrize("kind", ["trees", "linear", "listwise"])
def test_contributions_and_base_sum_to_the_score(planted, kind):
    model = L.train_ranker(planted, kind, NAMES)
    parts = L.feature_contributions(model, planted, NAMES)
    sums = {(r["query"], r["doc"]): r["s"] for r in parts.groupBy("query", "doc").agg({"contribution": "sum"}).withColumnRenamed("sum(contribution)", "s").collect()}
    scores = L.score_ranker(model, planted, NAMES).collect()
    base = L.contribution_base(model)
    assert len(sums) == len(scores) == planted.count()
    for r in scores:
        assert sums[r["query"], r["doc"]] + base == pytest.approx(r["score"], abs=1e-9)
    if kind == "trees":  # by walking the first tree for some rows
        tree = model.trees[0]._java_obj.rootNode()
        for r in scores[:20]:
            node, want = tree, dict.fromkeys(NAMES, 0.0)
            while node.getClass().getSimpleName().startswith("Internal"):
                split = node.split()
                to = node.leftChild() if r[NAMES[split.featureIndex()]] <= split.threshold() else node.rightChild()
                want[NAMES[split.featureIndex()]] += to.prediction() - node.prediction()
                node = to
            row = planted.filter((planted["query"] == r["query"]) & (planted["doc"] == r["doc"])).select(L.path_shares(tree, NAMES).alias("p")).first()["p"]
            assert row == pytest.approx([want[n] for n in NAMES])
    assert topk(parts, ["query", "doc"], ["feature"], 1).count() == planted.count()
