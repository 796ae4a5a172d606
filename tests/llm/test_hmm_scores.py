"""Scores of the language model against plain Baum-Welch over enumerated sequences, and the dealing by length."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from specloom.llm import hmm


def plain_counts(model, x):
    """Unscaled forward and backward tables of one short sequence: likelihood and expected counts."""
    k, n = len(model.start), len(x)
    ahead, back = np.zeros((n, k)), np.ones((n, k))
    for t in range(n):
        for j in range(k):
            into = model.start[j] if t == 0 else sum(ahead[t - 1, i] * model.move[i, j] for i in range(k))
            ahead[t, j] = into * model.emit[j, x[t]]
    for t in range(n - 2, -1, -1):
        for i in range(k):
            back[t, i] = sum(model.move[i, j] * model.emit[j, x[t + 1]] * back[t + 1, j] for j in range(k))
    z = ahead[-1].sum()
    move, emit = np.zeros((k, k)), np.zeros(model.emit.shape)
    for t in range(n):
        emit[:, x[t]] += ahead[t] * back[t] / z
        if t:
            move += np.outer(ahead[t - 1], model.emit[:, x[t]] * back[t]) * model.move / z
    return z, ahead[0] * back[0] / z, move, emit


def test_scores_equal_plain_baum_welch(spark):
    rng = np.random.default_rng(3)
    stock = [f"{a}{b}" for a in "abcdef" for b in ("x", "yy", "zzz")]
    rows = [(i, " ".join(rng.choice(stock, rng.integers(0, 9)))) for i in range(40)] + [(40, None), (41, "new words here"), (None, "ax ayy"), (3, "ax ayy"), (3, "ax ayy")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = hmm.hmm_scores(table, states=3, frequent=4, hashed=3, rounds=2, settled=0.0, seed=5).collect()

    split = [(d, [*(t or "").encode().lower().split(), b"\n"]) for d, t in rows]
    learned = [zlib.crc32(str("" if d is None else d).encode()) % 7 != 2 for d, _ in split]
    count = Counter(w for (_, ws), yes in zip(split, learned) if yes for w in ws)
    dictionary = [(1, w, count[w]) for w in {w for _, ws in split for w in ws}]
    tokens = spark.createDataFrame(dictionary, "kind int, word binary, n_learned long")
    kind = {bytes(r["word"]): r["class"] for r in hmm.vocabulary(tokens, 4, 3).collect()}
    mass, known = np.zeros(8), np.zeros(8)
    for w, c in count.items():
        mass[kind[w]] += c
        known[kind[w]] += 1
    share = mass / mass.sum()
    model = hmm.Model.drawn(share, 3, 5)
    for _ in range(2):
        sums = [np.zeros(3), np.zeros((3, 3)), np.zeros((3, 8))]
        for (_, ws), yes in zip(split, learned):
            if yes:
                for total, part in zip(sums, plain_counts(model, [kind[w] for w in ws])[1:]):
                    total += part
        model = hmm.Model.of_counts(*sums, share)

    def inner(w):
        return 0.0 if kind[w] <= 4 else math.log10((count[w] + 1) / (mass[kind[w]] + known[kind[w]] + 1))

    want = [(-1 if d is None else d, math.log10(plain_counts(model, [kind[w] for w in ws])[0]) + sum(map(inner, ws))) for d, ws in split]
    assert np.array(sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in got)) == pytest.approx(np.array(sorted(want)), abs=1e-9)


def test_documents_of_like_length_share_tasks(spark):
    sizes = [3] * 900 + [40] * 200 + [1000] * 30 + [9000] * 4
    table = spark.createDataFrame([(n,) for n in sizes], "size int")
    tasks, borders = hmm.dealt_by_length(table, 8000)
    assert [b[0] for b in borders] == sorted({b[0] for b in borders}) and borders[0][1] == 0
    assert all(later[1] == early[1] + early[2] for early, later in zip(borders, borders[1:]))
    assert tasks == borders[-1][1] + borders[-1][2] and borders[-1][2] >= 4
    assert hmm.dealt_by_length(table.where(F.lit(False))) == (1, [])
