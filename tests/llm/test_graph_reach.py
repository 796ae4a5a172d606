"""Graph search with many vectors of one direction: every node is reachable and recall holds."""

import numpy as np
import pytest

from specloom.llm import ann


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_recall_beside_many_vectors_of_one_direction(spark, seed):
    rng = np.random.default_rng(seed)
    line = rng.normal(size=24)
    x = np.concatenate([rng.normal(size=(1200, 24)), line * rng.uniform(0.1, 9, (300, 1)), line + rng.normal(size=(200, 24)) * 0.01])[rng.permutation(1700)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(50, x[50].tolist())] * 7, "vec_id long, embedding array<double>")
    u = ann.unit(x)
    got = {}
    for r in ann.nearest(rows).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hits = []
    for q in range(0, 1700, 50):
        sims = u @ u[q]
        sims[q] = -2
        fifth = np.sort(sims)[-5]
        assert len(got[q]) == 5 and q not in got[q] and all(abs(s - sims[i]) < 1e-12 for i, s in got[q].items())
        hits += [s >= fifth - 1e-12 for s in got[q].values()]
    assert np.mean(hits) >= 0.9, np.mean(hits)


def test_every_node_is_reachable():
    rng = np.random.default_rng(1)
    x = ann.unit(np.concatenate([rng.normal(size=(900, 24)), rng.normal(size=24) * rng.uniform(0.1, 9, (300, 1))])).astype(np.float32)
    graph, entry = ann.build_graph(x)
    assert len(ann.entries(graph, entry)) == len(entry)


def test_more_entries_than_the_beam_is_wide():
    x = ann.unit(np.random.default_rng(3).normal(size=(40, 6))).astype(np.float32)
    graph = np.full((40, 2), -1)
    entry = ann.entries(graph, np.array([7]))
    assert sorted(entry.tolist()) == list(range(40))
    found, _ = ann.beam_search(x, graph, x, entry, 5)
    assert (found[:, 0] == np.arange(40)).all()
