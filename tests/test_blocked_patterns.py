"""Blocked BM25 against full scoring (ties, negative idf, thresholds), counted ranks, and many patterns in whole texts."""

import random

import pytest

from specloom.operators import blocked, fusion
from specloom.operators.bm25 import bm25_scores, bm25_search, build_bm25, query_terms
from specloom.operators.patterns import pattern_hits
from specloom.operators.ranking import topk

WORDS = [f"w{i}" for i in range(30)]


@pytest.fixture(scope="module")
def tables(spark):
    """900 texts of 1 to 300 words with a hot word (negative idf), equal texts, texts without a word and null ones."""
    rng = random.Random(2)
    rows = []
    for i in range(880):
        n = int(2 ** rng.uniform(0, 8.2))
        words = [WORDS[min(29, int(rng.expovariate(0.2)))] for _ in range(n)]
        rows.append((i, " ".join([*words, "hot"] if rng.random() < 0.9 else words)))
    rows += [(880 + i, rows[7][1]) for i in range(10)] + [(895, ""), (896, None), (897, "?!"), (898, "w1"), (899, "w1")]
    queries = [(q, " ".join(rng.choice([*WORDS, "hot", "none"]) for _ in range(rng.randint(1, 9)))) for q in range(25)]
    queries += [(25, "hot"), (26, "none"), (27, ""), (28, "w1 w1 w2 hot"), (29, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc long, text string")
    return docs, spark.createDataFrame(queries, "query long, text string"), build_bm25(docs, "doc", "text")


@pytest.mark.parametrize("block_docs,query_rows,one_pass", [(2048, 2000, 64), (8, 7, 64), (8, 2000, 1), (3, 5, 1)])
@pytest.mark.parametrize("positive_only", [True, False])
def test_blocked_search_equals_full_scoring(tables, monkeypatch, block_docs, query_rows, one_pass, positive_only):
    monkeypatch.setattr(blocked, "ONE_PASS", one_pass)
    _, queries, index = tables
    got = bm25_search(queries, index, 6, "query", "text", positive_only, block_docs=block_docs, query_rows=query_rows)
    full = bm25_scores(queries, index, "query", "text")
    want = topk(full.filter("score > 0") if positive_only else full, ["query"], ["-score", "doc"], 6)
    shown = lambda df: sorted((r["query"], r["rank"], r["doc"], round(r["score"], 7)) for r in df.collect())
    assert shown(got) == shown(want)


def test_blocks_below_the_threshold_are_skipped(tables):
    """With a threshold most blocks of few documents have a bound below it, and no bound is below a score."""
    _, queries, index = tables
    asked = blocked.weights(index, query_terms(queries, "query", "text", index.variant))
    classes, d = blocked.length_blocks(index, 8)
    parts = blocked.dealt_by_length(blocked.contributions(index, asked), classes)
    lists = blocked.by_query(asked.toArrow())
    least = {r["query"]: r["score"] for r in bm25_search(queries, index, 3, "query", "text").filter("rank = 3").collect()}
    scored = skipped = 0
    table = parts.toArrow()
    for b in range(d):
        held = blocked.Block(table.filter(blocked.pc.equal(table["_db"], b)))
        for query, (names, w) in lists.items():
            terms = held.terms(names, w)
            score, _ = held.scores(terms)
            assert held.bound(terms) >= score.max()
            if query in least:
                scored += 1
                skipped += held.bound(terms) < least[query]
    assert skipped > 0.3 * scored


@pytest.mark.parametrize("block_docs,query_rows", [(2048, 2000), (50, 4)])
def test_first_and_counted_ranks_equal_a_full_sort(spark, tables, block_docs, query_rows):
    docs, queries, index = tables
    corpus, asked = docs.select("doc"), query_terms(queries, "query", "text", index.variant)
    scores = {(r["query"], r["doc"]): r["score"] for r in bm25_scores(queries, index, "query", "text").collect()}
    ids = [r["doc"] for r in corpus.collect()]
    order = {}
    for (q,) in queries.select("query").collect():
        listed = sorted(((-scores.get((q, d), 0.0), d) for d in ids))
        order[q] = {d: (i, -s) for i, (s, d) in enumerate(listed, 1)} if listed[0][0] < 0 else None
    first = blocked.first_ranks(index, asked, corpus, 40, block_docs, query_rows).collect()
    assert {(r["query"], r["doc"], r["rank"]) for r in first} == {(q, d, i) for q, x in order.items() if x for d, (i, _) in x.items() if i <= 40}
    pairs = spark.createDataFrame([(q, d) for q in order for d in ids if (q * 31 + d) % 23 == 0], "query long, doc long")
    got = blocked.counted_ranks(index, asked, corpus, pairs, block_docs, query_rows).collect()
    assert len(got) == pairs.count()
    for r in got:
        place = order[r["query"]]
        assert r["lexical_rank"] == (place[r["doc"]][0] if place else None)
        assert r["bm25_score"] == pytest.approx(scores.get((r["query"], r["doc"]), 0.0), abs=1e-8)


@pytest.mark.parametrize("part_rows,block_rows", [(20_000, 500), (3, 2)])
def test_patterns_anywhere_in_whole_texts(spark, part_rows, block_rows):
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("ab 1é") for _ in range(n))
    texts = [(i, letters(rng.randint(0, 400))) for i in range(12)] + [(12, None), (13, ""), (13, "aab"), (14, "x" * 100_000 + " code-77")]
    patterns = [letters(rng.randint(1, 4)) for _ in range(30)] + ["code-77", "", None, "absent!", "a", "aa", "aab", "a"]
    got = pattern_hits(spark.createDataFrame(texts, "query long, text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string"), part_rows, block_rows)
    want = {(q, p) for q, t in texts for p in patterns if p and t is not None and p in t}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) and (14, "code-77") in want


def test_alias_and_code_in_the_last_words_of_a_record(spark):
    from specloom.plans import q_retrieval as Q
    from specloom.plans.registry import Tables

    documents = spark.createDataFrame([(1, "One two three four. Five six seven eight is 4-2b"), (2, "plain words\nNine ten eleven end"), (3, None), (50, "see is 4-2b, five six seven")], "doc_id long, text string")
    tables = Tables.__new__(Tables)
    tables.__dict__.update(documents=documents)
    assert {tuple(r) for r in Q.doc_aliases(tables).collect()} == {(1, "one two three"), (1, "five six seven"), (2, "nine ten eleven"), (50, "see is 4-2b,")}
    assert {tuple(r) for r in Q.doc_designations(tables).collect()} == {(1, "4-2b"), (50, "4-2b,")}
    queries = spark.createDataFrame([(1, "it is is 4-2b, Five six seven"), (2, "xnine ten eleven")], "query long, text string")
    hits = fusion.designation_hits(queries, Q.doc_designations(tables)).collect()
    assert {tuple(r) for r in hits} == {(1, 1, 1), (1, 50, 1)}
    assert {(r["query"], r["doc"]) for r in fusion.alias_hits(queries, Q.doc_aliases(tables)).collect()} == {(1, 1)}
