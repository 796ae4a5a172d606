import math
import random
from collections import Counter

import numpy as np
import pytest

from specloom.operators import dense, fusion, metrics
from specloom.operators.bm25 import bm25_search, build_bm25, full_text_search
from specloom.operators.ranking import exact_rank, topk
from specloom.plans import views as W


def brute_bm25(docs, query):
    toks = {d: t.split() for d, t in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(w for t in toks.values() for w in set(t))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    out = {}
    for d, t in toks.items():
        tf = Counter(t)
        out[d] = round(sum(idf.get(w, 0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in query.split() if tf[w]), 9) + 0.0
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = ["steel", "bar", "wire", "copper", "cement", "grade", "pipe", "valve", "the", "of"]
    docs = {i: " ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for i in range(60)}
    docs[60] = docs[3]
    queries = {0: "steel bar of the steel", 1: "copper", 2: "zinc", 3: "the"}
    return docs, queries


def frames(spark, corpus):
    docs, queries = corpus
    return (spark.createDataFrame(list(docs.items()), ["doc", "text"]), spark.createDataFrame(list(queries.items()), ["query", "text"]))


def test_bm25_matches_brute_force(spark, corpus):
    d, q = frames(spark, corpus)
    hits = bm25_search(q, build_bm25(d, "doc", "text"), 7, "query", "text").collect()
    for qid, text in corpus[1].items():
        want = sorted(((s, -i) for i, s in brute_bm25(corpus[0], text).items() if s > 0), reverse=True)[:7]
        got = [(r.score, -r.doc) for r in sorted((h for h in hits if h.query == qid), key=lambda r: r.rank)]
        assert [x[1] for x in got] == [x[1] for x in want]


def test_full_text_needs_every_word(spark, corpus):
    d, q = frames(spark, corpus)
    got = {(r.query, r.doc) for r in full_text_search(q, build_bm25(d, "doc", "text"), 100, "query", "text").collect()}
    want = {(k, i) for k, t in corpus[1].items() for i, x in corpus[0].items() if set(t.split()) <= set(x.split())}
    assert got == want


def vectors(spark, n, dim, seed, key):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim)).round(1)
    m[n // 2] = m[0]
    return m, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], [key, "vec"])


def test_dense_search_in_small_blocks(spark):
    dm, d = vectors(spark, 50, 5, 1, "doc")
    qm, q = vectors(spark, 9, 5, 2, "query")
    got = sorted((r.query, r["rank"], r.doc) for r in dense.dense_search(q, d, 4, block_rows=7).collect())
    sims = np.round(qm @ dm.T, 9)
    want = [(i, k + 1, j) for i in range(9) for k, j in enumerate(sorted(range(50), key=lambda j: (-sims[i, j], j))[:4])]
    assert got == sorted(want)


@pytest.mark.parametrize("k", [1, 3])
def test_fused_search_equals_scoring_everything(spark, corpus, k):
    docs, queries = corpus
    rng = random.Random(1)
    docs = {i: docs[i % 61] + (" extra" if i % 3 else "") for i in range(400)}
    dm, dv = vectors(spark, 400, 4, 3, "doc")
    qm, qv = vectors(spark, 4, 4, 4, "query")
    status = {i: rng.choice(["active", "superseded"]) for i in docs}
    alias = {5: "steel bar", 7: "zinc", 9: "bar of"}
    desig = [(i, "cop") for i in range(0, 400, 50)]
    d, q = frames(spark, (docs, queries))
    c = spark.createDataFrame([(i, status[i]) for i in docs], ["doc", "status"])
    got = fusion.fused_search(q, c, build_bm25(d, "doc", "text"), qv, dv, k, spark.createDataFrame(list(alias.items()), ["doc", "alias"]),
                              spark.createDataFrame(desig, ["doc", "designation"])).collect()
    sims = np.round(qm @ dm.T, 9)
    for qid, text in queries.items():
        lex = brute_bm25(docs, text)
        signal = max(lex.values()) > 0
        lr = {i: r + 1 for r, i in enumerate(sorted(docs, key=lambda i: (-lex[i], i)))}
        sr = {i: r + 1 for r, i in enumerate(sorted(docs, key=lambda i: (-sims[qid, i], i)))}
        score = {}
        for i in docs:
            s = (0.5 / (60 + lr[i]) if signal else 0) + 1 / (60 + sr[i])
            s += 0.05 * sum(1 for j, x in desig if j == i and x in text)
            s += 0.05 * (1 + len(alias[i]) / 40) if i in alias and f" {alias[i]} " in f" {text} " else 0
            score[i] = round(s * (1 if status[i] == "active" else 0.6), 12)
        want = sorted(docs, key=lambda i: (-score[i], i))[:k]
        rows = sorted((r for r in got if r.query == qid), key=lambda r: r["rank"])
        assert [r.doc for r in rows] == want
        assert [(r.lexical_rank, r.semantic_rank) for r in rows] == [(lr[i] if signal else None, sr[i]) for i in want]


def test_exact_rank_of_one_hot_group(spark):
    df = spark.range(5000).selectExpr("'hot' AS g", "id % 37 AS s", "id")
    got = {r.id: r["rank"] for r in exact_rank(df, ["g"], ["-s", "id"]).collect()}
    want = sorted(range(5000), key=lambda i: (-(i % 37), i))
    assert [got[i] for i in want] == list(range(1, 5001))


def test_topk_prunes_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "id")
    plan = topk(df, ["g"], ["-id"], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_rrf_arithmetic(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], ["query", "doc", "rank"])
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], ["query", "doc", "rank"])
    got = {r.doc: r.score for r in fusion.rrf([a, b]).collect()}
    assert got["y"] == pytest.approx(1 / 62 + 1 / 61, abs=1e-6) and got["x"] == pytest.approx(1 / 61, abs=1e-6) and len(got) == 3


def test_rerank_passthrough_for_other_scripts(spark):
    rows = [(1, f"d{i}", i, "active", "पानी की पाइप", float(-i)) for i in range(1, 13)] + [(2, f"d{i}", i, "active" if i > 1 else "superseded", "water pipe", float(i)) for i in range(1, 13)]
    out = fusion.rerank_fuse(spark.createDataFrame(rows, ["query", "doc", "rank", "status", "text", "s"]), "s", "text").collect()
    assert all(r.final_rank == r["rank"] for r in out if r.query == 1 or r["rank"] > 10)
    assert next(r for r in out if r.query == 2 and r["rank"] == 1).final_rank > 1


def test_penalty_floors_and_reports(spark):
    rows = [(1, "old", 0.9, "superseded", "F"), (1, "new", 0.8, "active", "F"), (1, "other", 0.1, "active", "G")]
    out = {r.doc: r for r in fusion.supersession_penalty(spark.createDataFrame(rows, ["query", "doc", "score", "status", "family"]), k=2).collect()}
    assert out["old"].final_score == 0.0 and out["old"].superseded_by == "new" and out["old"].nearby_superseded and out["new"].final_rank == 1
    alone = fusion.supersession_penalty(spark.createDataFrame(rows[:1], ["query", "doc", "score", "status", "family"])).first()
    assert alone.superseded_by is None and alone.final_score == 0.9


def test_orphan_gate_reasons(spark):
    q = spark.createDataFrame([(i,) for i in range(1, 7)], ["query"])
    hits = [(2, "a", 0.9, 1), (3, "b", 0.9, 1), (4, "a", 0.80, 1), (4, "c", 0.75, 2), (5, "b", 0.80, 1), (5, "c", 0.75, 2), (6, "c", 0.9, 1), (6, "d", 0.3, 2)]
    out = {r.query: r for r in fusion.orphan_gate(q, spark.createDataFrame(hits, ["query", "doc", "score", "rank"]), spark.createDataFrame([("a",)], ["doc"])).collect()}
    assert [out[i].reason for i in range(1, 7)] == ["no_candidates", None, "single_candidate_no_corroboration", None, "insufficient_margin", None]
    assert out[6].corroborated is None and out[4].corroborated is True


def test_metrics(spark):
    q = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], ["query", "kind"])
    hits = spark.createDataFrame([(1, "x", 1), (2, "y", 1), (2, "x", 2)], ["query", "doc", "rank"])
    rel = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], ["query", "doc"])
    out = {r.kind: r for r in metrics.ir_metrics(q, hits, rel).collect()}
    assert out["OVERALL"].recall_3 == pytest.approx(2 / 3, abs=1e-6) and out["a"].mrr == 0.75 and out["b"].mrr == 0


@pytest.mark.parametrize("k", [1, 5, 20])
def test_fused_search_with_rare_and_with_half_frequent_words(spark, k):
    """Two documents hold the rare word; another word is in exactly half of the documents (score 0), one in most (negative)."""
    n = 240
    docs = {i: "common " * (i % 8 > 0) + "half " * (i % 2) + "filler" + " rare" * (i in (150, 190)) for i in range(n)}
    queries = {0: "rare", 1: "half", 2: "rare half common"}
    dm, dv = vectors(spark, n, 4, 5, "doc")
    qm, qv = vectors(spark, 3, 4, 6, "query")
    d, q = frames(spark, (docs, queries))
    c = spark.createDataFrame([(i, "superseded" if i % 3 == 0 else "active") for i in docs], ["doc", "status"])
    got = fusion.fused_search(q, c, build_bm25(d, "doc", "text"), qv, dv, k).collect()
    sims = np.round(qm @ dm.T, 9)
    for qid, text in queries.items():
        lex = brute_bm25(docs, text)
        signal = max(lex.values()) > 0
        lr = {i: r + 1 for r, i in enumerate(sorted(docs, key=lambda i: (-lex[i], i)))}
        sr = {i: r + 1 for r, i in enumerate(sorted(docs, key=lambda i: (-sims[qid, i], i)))}
        score = {i: round(((0.5 / (60 + lr[i]) if signal else 0) + 1 / (60 + sr[i])) * (0.6 if i % 3 == 0 else 1), 12) for i in docs}
        want = sorted(docs, key=lambda i: (-score[i], i))[:k]
        rows = sorted((r for r in got if r["query"] == qid), key=lambda r: r["rank"])
        assert [r["doc"] for r in rows] == want
        assert [r["lexical_rank"] for r in rows] == [lr[i] if signal else None for i in want]


def test_dense_search_null_zero_tied_and_short_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, [0.5, 0.5])]
    docs = spark.createDataFrame(rows, "doc long, vec array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query long, vec array<double>")
    got = sorted((r["query"], r["rank"], r["doc"]) for r in dense.dense_search(queries, docs, 2).collect())
    assert got == [(1, 1, 1), (1, 2, 3), (2, 1, 1), (2, 2, 3)]
    with pytest.raises(Exception, match="another length"):
        dense.dense_search(queries, docs.unionByName(spark.createDataFrame([(9, [1.0])], docs.schema)), 2).collect()


def test_containing_finds_every_place(spark):
    docs = [(1, "see (alpha beta gamma), then more"), (2, "alpha  beta gamma"), (3, "xalpha beta gammay end"), (4, "alpha gamma beta"), (5, None),
            (6, ""), (7, "one two three four five six seven eight nine ten"), (8, "zone two three four five six seven eight nine tent"), (9, "prealphapost")]
    passages = [(1, "alpha beta gamma"), (2, "alpha  beta gamma"), (3, "lph"), (4, "alpha beta"), (5, "one two three four five six seven eight nine ten"),
                (6, " "), (7, ""), (8, None), (9, "gamma), "), (10, "(alpha"), (11, "two three four five six seven eight nine te")]
    found = W.containing(spark.createDataFrame(passages, "query long, text string"), spark.createDataFrame(docs, "doc long, text string"))
    want = {(q, d) for q, p in passages for d, t in docs if p and p.strip() and t and p in t}
    rows = [tuple(r) for r in found.select("query", "doc").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_containing_in_no_documents(spark):
    none = spark.createDataFrame([], "doc long, text string")
    assert W.containing(spark.createDataFrame([(1, "a b c")], "query long, text string"), none).count() == 0


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_pooled_search_reads_every_chunk(spark, block_rows, monkeypatch):
    rng = np.random.default_rng(5)
    q, own, chunks = rng.normal(size=(4, 6)), rng.normal(size=(9, 6)), rng.normal(size=(60, 6))
    owner = rng.integers(0, 14, 60)  # owners from 9 on have chunks only
    frame = lambda ids, vecs, key: spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vecs)], f"{key} long, vec array<double>")
    monkeypatch.setattr(dense, "_cut", lambda n, rows: max(1, -(-n // block_rows)))
    hits = dense.pooled_search(frame(range(4), q, "query"), frame(range(9), own, "doc"), frame(owner, chunks, "doc"), 5, 0.88).collect()
    for i in range(4):
        best = {}
        for d, v in [*zip(range(9), own), *zip(owner.tolist(), 0.88 * chunks)]:
            best[d] = max(best.get(d, -np.inf), round(float(q[i] @ v), 9))
        want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]
        got = sorted((r["rank"], r["doc"], r["similarity"]) for r in hits if r["query"] == i)
        assert [g[1] for g in got] == [w[0] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[1] for w in want])


def test_pool_chunks_keeps_owners_without_a_hit(spark):
    own = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.9)], "query long, doc long, similarity double")
    chunks = spark.createDataFrame([(1, 1, 1.0), (1, 3, 0.5)], "query long, doc long, similarity double")
    got = {r["doc"]: round(r["similarity"], 6) for r in dense.pool_chunks(own, chunks, 0.88).collect()}
    assert got == {1: 0.88, 2: 0.9, 3: 0.44}
