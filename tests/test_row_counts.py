from collections import Counter

from specloom.functions import rows as R
from specloom.operators import bm25


def test_tokens_are_counted_in_their_row_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(R, "SLICE_TOKENS", 3)
    texts = {1: "a b a c", 2: "b b b", 3: "", 4: None, 5: "A b", 6: "--", 7: "d d e f g h i d"}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string").coalesce(1)
    rows = bm25.row_counts(docs.select(docs["id"].alias("doc"), bm25.tokens("text").alias("tokens")))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    want = {(t, d, len(x.split()), n) for d, x in texts.items() if x and x != "--" for t, n in Counter(x.lower().split()).items()}
    assert sorted(map(tuple, rows.collect())) == sorted(want)
    index = bm25.build_bm25(docs, "id", "text")
    assert sorted((r["term"], r["doc"], r["dl"], r["tf"]) for r in index.postings.collect()) == sorted(want)
    again = bm25.build_bm25(docs.unionByName(docs), "id", "text")
    assert sorted((r["term"], r["doc"], r["dl"], r["tf"]) for r in again.postings.collect()) == sorted((t, d, m, 2 * n) for t, d, m, n in want)


def test_vectors_are_made_in_the_row_of_their_text(spark, monkeypatch):
    import hashlib
    import math

    from specloom.functions.encode import hashing_encoder

    monkeypatch.setattr(R, "SLICE_TOKENS", 3)
    texts = {1: "a b a c", 2: "b b b", 3: "", 4: None, 5: "A b", 7: "d d e f g h i d"}

    def want(text):
        counts = [0.0] * 8
        for w in (text or "").lower().split():
            counts[int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 8] += 1
        norm = math.sqrt(sum(c * c for c in counts)) or 1.0
        return [c / norm for c in counts]

    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    vecs = hashing_encoder(docs, "id", "text", 8)
    assert "Exchange" not in vecs._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["vec"] for r in vecs.collect()} == {d: want(x) for d, x in texts.items()}
    twice = hashing_encoder(docs.unionByName(spark.createDataFrame([(1, "d")], docs.schema)), "id", "text", 8).collect()
    assert sorted((r["id"], r["vec"]) for r in twice) == sorted([(d, want(x)) for d, x in texts.items() if d != 1] + [(1, want("a b a c d"))] * 2)


def test_ranking_rows_search_once(spark, monkeypatch):
    from specloom.plans import q_feedback as Q
    from specloom.plans.registry import Tables

    asked, own = [], Q.sparse50
    monkeypatch.setattr(Q, "sparse50", lambda t: asked.append(1) or own(t))
    Q.labelled(Tables(spark, "/root/testdata/sf0.001"))
    assert len(asked) == 1
