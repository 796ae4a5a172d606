"""Retrieval, fusion and quality queries over documents, benchmark and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from specloom.functions import vocab as V
from specloom.functions.encode import hashing_encoder
from specloom.operators import dense, fusion, metrics
from specloom.operators.bm25 import bm25_scores, bm25_search, build_bm25, full_text_search
from specloom.operators.ranking import exact_rank, maxnorm, minmax, topk
from specloom.plans import views as W
from specloom.plans.registry import Tables, query
from specloom.session import cut_lineage

BM25 = (W.BENCH, W.DOCS, W.bm25_cte("dc", "bq"))
BM25_TOP = (*BM25, """sparse AS (SELECT * FROM (SELECT query, doc, score,
 row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM score WHERE score > 0) WHERE rank <= 50)""")
TEXT_VECS = (W.encode_cte("qv", "bq", "query"), W.encode_cte("dv", "dc", "doc"))
DENSE_ALL = """pairs AS (SELECT q.query, d.doc FROM bq q CROSS JOIN dc d),
sims AS (SELECT p.query, p.doc, round(coalesce(s, 0), 9) AS similarity FROM pairs p LEFT JOIN
 (SELECT query, doc, sum(qv.w * dv.w) AS s FROM qv JOIN dv USING (bucket) GROUP BY query, doc) USING (query, doc)),
semr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, doc) AS semantic_rank FROM sims)"""
DENSE_TOP = (*TEXT_VECS, DENSE_ALL, "den AS (SELECT query, doc, similarity, semantic_rank AS rank FROM semr WHERE semantic_rank <= 50)")


def text_vectors(t: Tables):
    """Stored vectors tables: encoded once, then read by every step."""
    q = hashing_encoder(W.bench_queries(t), "query", "text")
    d = hashing_encoder(W.doc_corpus(t), "doc", "text")
    return cut_lineage(q), cut_lineage(d)


def sparse50(t: Tables):
    return bm25_search(W.bench_queries(t), build_bm25(W.doc_corpus(t), "doc", "text"), 50, "query", "text")


def dense50(t: Tables):
    return dense.dense_search(*text_vectors(t), 50)


@query("bm25_topk", W.cte(*BM25) + """SELECT query, doc, round(score, 6) AS score, rank FROM (SELECT *,
 row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM score WHERE score > 0) WHERE rank <= 5""")
def _(t: Tables):
    hits = bm25_search(W.bench_queries(t), build_bm25(W.doc_corpus(t), "doc", "text"), 5, "query", "text")
    return hits.select("query", "doc", F.round("score", 6).alias("score"), "rank")


@query("bm25_topk_stopwords", W.cte(W.BENCH, W.DOCS, W.bm25_cte("dc", "bq", stop=V.STOPWORDS)) + """SELECT query, doc, round(score, 6) AS score, rank
 FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM score WHERE score > 0) WHERE rank <= 10""")
def _(t: Tables):
    hits = bm25_search(W.bench_queries(t), build_bm25(W.doc_corpus(t), "doc", "text", "stop"), 10, "query", "text")
    return hits.select("query", "doc", F.round("score", 6).alias("score"), "rank")


@query("bm25_postings", W.cte(W.BENCH, W.DOCS, W.bm25_cte("dc", "bq")) + "SELECT term, post.doc, tf, dl FROM post JOIN dlen ON dlen.doc = post.doc")
def _(t: Tables):
    return build_bm25(W.doc_corpus(t), "doc", "text").postings.select("term", "doc", "tf", "dl")


@query("bm25_term_stats", W.cte(W.BENCH, W.DOCS, W.bm25_cte("dc", "bq")) + "SELECT term, df, round(idf, 6) AS idf, n, round(avgdl, 6) AS avgdl FROM idfs, tot")
def _(t: Tables):
    ix = build_bm25(W.doc_corpus(t), "doc", "text")
    n, avg = ix.totals.select("n").scalar(), ix.totals.select("avgdl").scalar()
    return ix.terms.select("term", "df", F.round("idf", 6).alias("idf"), n.alias("n"), F.round(avg, 6).alias("avgdl"))


@query("full_text_all_terms", W.cte(W.BENCH, W.DOCS, W.bm25_cte("dc", "bq")) + """SELECT query, doc, score, rank FROM (
 SELECT q.query, p.doc, sum(tf)::BIGINT AS score, row_number() OVER (PARTITION BY q.query ORDER BY sum(tf) DESC, p.doc) AS rank
 FROM qtok q JOIN post p USING (term) GROUP BY q.query, p.doc
 HAVING count(*) = (SELECT count(*) FROM qtok x WHERE x.query = q.query)) WHERE rank <= 10""")
def _(t: Tables):
    return full_text_search(W.bench_queries(t), build_bm25(W.doc_corpus(t), "doc", "text"), 10, "query", "text")


VEC = """vec AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
vsim AS (SELECT q.vec_id AS query, d.vec_id AS doc, d.label AS label, q.label AS qlabel, round(list_dot_product(q.e, d.e), 9) AS similarity
 FROM vec q, vec d)"""


@query("dense_topk", W.cte(VEC) + """SELECT query, doc, round(similarity, 6) AS similarity, rank FROM (SELECT *,
 row_number() OVER (PARTITION BY query ORDER BY similarity DESC, doc) AS rank FROM vsim) WHERE rank <= 10""")
def _(t: Tables):
    v = W.vectors(t)
    hits = dense.dense_search(v.select(F.col("doc").alias("query"), "vec"), v, 10)
    return hits.select("query", "doc", F.round("similarity", 6).alias("similarity"), "rank")


@query("dense_topk_prefilter", W.cte(VEC) + """SELECT query, doc, round(similarity, 6) AS similarity, rank FROM (SELECT *,
 row_number() OVER (PARTITION BY query ORDER BY similarity DESC, doc) AS rank FROM vsim WHERE label % 2 = 0) WHERE rank <= 5""")
def _(t: Tables):
    v = W.vectors(t)
    hits = dense.dense_search(v.select(F.col("doc").alias("query"), "vec"), v.filter(F.col("label") % 2 == 0), 5)
    return hits.select("query", "doc", F.round("similarity", 6).alias("similarity"), "rank")


@query("dense_topk_over_fetch", W.cte(VEC) + """SELECT query, doc, round(similarity, 6) AS similarity, rank FROM (SELECT *,
 row_number() OVER (PARTITION BY query ORDER BY similarity DESC, doc) AS rank FROM (SELECT *,
 row_number() OVER (PARTITION BY query ORDER BY similarity DESC, doc) AS wide FROM vsim) WHERE wide <= 10 AND label % 2 = 0) WHERE rank <= 5""")
def _(t: Tables):
    v = W.vectors(t)
    wide = dense.dense_search(v.select(F.col("doc").alias("query"), "vec"), v, 10).drop("rank")
    hits = wide.withColumnRenamed("similarity", "score").join(v.select("doc", "label"), "doc")
    out = fusion.topk_filtered(hits, F.col("label") % 2 == 0, 5, mode="after")
    return out.select("query", "doc", F.round("score", 6).alias("similarity"), "rank")


@query("dense_min_similarity", W.cte(VEC) + """SELECT query, doc, round(similarity, 6) AS similarity FROM (SELECT *,
 row_number() OVER (PARTITION BY query ORDER BY similarity DESC, doc) AS rank FROM vsim WHERE similarity >= 0.45) WHERE rank <= 20""")
def _(t: Tables):
    v = W.vectors(t)
    hits = dense.dense_search(v.select(F.col("doc").alias("query"), "vec"), v, 20, floor=V.UNCITED_MIN_SIMILARITY)
    return hits.select("query", "doc", F.round("similarity", 6).alias("similarity"))


@query("chunk_max_pool", """WITH vec AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), ip AS (SELECT q.vec_id AS query, d.vec_id AS chunk, list_dot_product(q.e, d.e) AS s FROM vec q, vec d),
 pooled AS (SELECT query, doc, max(round(s, 9)) AS similarity FROM (SELECT query, chunk AS doc, s FROM ip UNION ALL SELECT query, chunk // 4, 0.88 * s FROM ip) GROUP BY query, doc)
 SELECT query, doc, rank, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, doc) AS rank FROM pooled) WHERE rank <= 20""")
def _(t: Tables):
    v = W.vectors(t)
    chunks = v.select(F.floor(F.col("doc") / 4).alias("doc"), "vec")
    hits = dense.pooled_search(v.select(F.col("doc").alias("query"), "vec"), v, chunks, 20, V.CHUNK_DAMPING)
    return hits.select("query", "doc", "rank", F.round("similarity", 6).alias("similarity"))


@query("hybrid_rrf", W.cte(*BM25_TOP, *DENSE_TOP) + """SELECT query, doc, round(score, 6) AS score, rank FROM (
 SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM (
 SELECT query, doc, round(sum(1.0 / (60 + rank)), 12) AS score FROM (
 SELECT query, doc, rank FROM sparse UNION ALL SELECT query, doc, rank FROM den) GROUP BY query, doc)) WHERE rank <= 20""")
def _(t: Tables):
    out = fusion.rrf([dense50(t), sparse50(t)], top=20)
    return out.select("query", "doc", F.round("score", 6).alias("score"), "rank")


@query("hybrid_weighted", W.cte(*BM25_TOP, *DENSE_TOP) + """SELECT query, doc, round(score, 6) AS score, rank FROM (
 SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM (
 SELECT query, doc, round(sum(p), 9) AS score FROM (
 SELECT query, doc, 0.6 * (similarity / CASE WHEN max(similarity) OVER (PARTITION BY query) > 0 THEN max(similarity) OVER (PARTITION BY query) ELSE 1 END) AS p FROM den
 UNION ALL SELECT query, doc, 0.4 * (score / CASE WHEN max(score) OVER (PARTITION BY query) > 0 THEN max(score) OVER (PARTITION BY query) ELSE 1 END) FROM sparse)
 GROUP BY query, doc)) WHERE rank <= 20""")
def _(t: Tables):
    d = dense50(t).withColumnRenamed("similarity", "score")
    out = fusion.weighted_fusion(d, sparse50(t), 20)
    return out.select("query", "doc", F.round("score", 6).alias("score"), "rank")


#: A sentence's first three words. White space is spelled out, because \s differs between engines.
OPENING = r"(?:^|[.!?][ \t\n\r\f]+|\n)([^ \t\n\r\f]+ [^ \t\n\r\f]+ [^ \t\n\r\f]+)"

#: tq: the benchmark items, and as long texts every document whose id 50 divides (under -1 - doc_id).
TEXT_QUERIES = """tq AS (SELECT query, text FROM bq UNION ALL SELECT -1 - doc_id, text FROM documents WHERE doc_id % 50 = 0)"""
ITEM_QUERIES = "tq AS (SELECT query, text FROM bq)"
ALIAS = """al AS (SELECT DISTINCT doc, lower(p) AS alias FROM (SELECT doc_id AS doc, unnest(regexp_extract_all(text, '%s', 1)) AS p FROM documents)),
ax AS (SELECT DISTINCT q.query, p.alias FROM tq q JOIN (SELECT DISTINCT alias FROM al) p ON contains(concat(' ', lower(q.text), ' '), concat(' ', p.alias, ' '))),
ah AS (SELECT query, doc, max(1.0 + length(alias) / 40.0) AS alias_score FROM ax JOIN al USING (alias) GROUP BY query, doc)""" % OPENING
DESIG = """de AS (SELECT DISTINCT doc, designation FROM (SELECT doc_id AS doc, unnest(string_split(lower(text), ' ')) AS designation FROM documents) WHERE regexp_matches(designation, '[0-9]')),
dx AS (SELECT DISTINCT q.query, p.designation FROM tq q JOIN (SELECT DISTINCT designation FROM de) p ON contains(lower(q.text), p.designation)),
dh AS (SELECT query, doc, count(*) AS designation_hits FROM dx JOIN de USING (designation) GROUP BY query, doc)"""


def text_queries(t: Tables):
    long = t.documents.filter(F.col("doc_id") % 50 == 0).select((F.lit(-1) - F.col("doc_id")).alias("query"), "text")
    return W.bench_queries(t).select("query", "text").unionByName(long)


def doc_aliases(t: Tables):
    """The opening words of all sentences of each document, each once in a row of the table."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(OPENING), F.lit(1)), F.lower))
    return t.documents.select(F.col("doc_id").alias("doc"), F.explode_outer(found).alias("alias")).filter(F.col("alias").isNotNull())


def doc_designations(t: Tables):
    """All words with a digit of each document."""
    words = t.documents.select(F.col("doc_id").alias("doc"), F.explode(F.split(F.lower("text"), " ")).alias("designation"))
    return words.filter(F.col("designation").rlike("[0-9]")).distinct()


@query("alias_phrase_hits", W.cte(W.BENCH, TEXT_QUERIES, ALIAS) + "SELECT query, doc, round(alias_score, 6) AS alias_score FROM ah")
def _(t: Tables):
    return fusion.alias_hits(text_queries(t), doc_aliases(t)).select(
        "query", "doc", F.round("alias_score", 6).alias("alias_score"))


@query("designation_substring_hits", W.cte(W.BENCH, TEXT_QUERIES, DESIG) + "SELECT query, doc, designation_hits FROM dh")
def _(t: Tables):
    return fusion.designation_hits(text_queries(t), doc_designations(t))


FUSED = """lexr AS (SELECT p.query, p.doc, coalesce(s.score, 0) AS bm25_score,
 row_number() OVER (PARTITION BY p.query ORDER BY coalesce(s.score, 0) DESC, p.doc) AS lr,
 max(coalesce(s.score, 0)) OVER (PARTITION BY p.query) > 0 AS sig FROM pairs p LEFT JOIN score s USING (query, doc)),
fus AS (SELECT l.query, l.doc, bm25_score, CASE WHEN sig THEN lr END AS lexical_rank, semantic_rank, similarity,
 coalesce(designation_hits, 0) AS designation_hits, alias_score IS NOT NULL AS alias_hit,
 round(CASE WHEN status <> 'active' THEN 0.6 ELSE 1.0 END * (CASE WHEN sig THEN 0.5 / (60 + lr) ELSE 0 END + 1.0 / (60 + semantic_rank)
 + 0.05 * coalesce(designation_hits, 0) + 0.05 * coalesce(alias_score, 0)), 12) AS score
 FROM lexr l JOIN semr USING (query, doc) JOIN dc USING (doc) LEFT JOIN ah USING (query, doc) LEFT JOIN dh USING (query, doc))"""
FUSED_SQL = (W.BENCH, W.DOCS, W.bm25_cte("dc", "bq", stop=V.STOPWORDS), *TEXT_VECS, DENSE_ALL, ITEM_QUERIES, ALIAS, DESIG, FUSED)


def fused(t: Tables, k: int):
    q, c = W.bench_queries(t), W.doc_corpus(t)
    qv, dv = text_vectors(t)
    return fusion.fused_search(q, c, build_bm25(c, "doc", "text", "stop"), qv, dv, k, doc_aliases(t), doc_designations(t))


@query("fused_search_exact", W.cte(*FUSED_SQL) + """SELECT query, doc, rank, round(score, 6) AS score, lexical_rank, semantic_rank,
 round(similarity, 6) AS similarity, round(bm25_score, 6) AS bm25_score, designation_hits, alias_hit FROM (SELECT *,
 row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM fus) WHERE rank <= 5""")
def _(t: Tables):
    r = F.round
    return fused(t, 5).select("query", "doc", "rank", r("score", 6).alias("score"), "lexical_rank", "semantic_rank",
                              r("similarity", 6).alias("similarity"), r("bm25_score", 6).alias("bm25_score"),
                              "designation_hits", "alias_hit")


def with_reranker(t: Tables):
    """BM25 top 20 with the hashing similarity standing in for a reranker's score."""
    hits = bm25_search(W.bench_queries(t), build_bm25(W.doc_corpus(t), "doc", "text"), 20, "query", "text")
    hits = dense.pair_similarity(hits, *text_vectors(t))
    return hits.join(W.doc_corpus(t).select("doc", "status", "family"), "doc").join(
        W.bench_queries(t).select("query", "text"), "query")


RERANK = (*BM25_TOP, *TEXT_VECS, DENSE_ALL, """h20 AS (SELECT s.query, s.doc, s.score, s.rank, m.similarity, dc.status, dc.family FROM sparse s
 JOIN sims m USING (query, doc) JOIN dc USING (doc) WHERE rank <= 20)""")


@query("rerank_fusion", W.cte(*RERANK) + """, h AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, rank) AS rr FROM h20 WHERE rank <= 10),
 f AS (SELECT *, round(CASE WHEN status <> 'active' THEN 0.6 ELSE 1.0 END * (1.0 / (5 + rank) + 1.0 / (5 + rr)), 12) AS rs FROM h)
 SELECT query, doc, rank, rr AS rerank_rank, round(rs, 6) AS reranked_score, row_number() OVER (PARTITION BY query ORDER BY rs DESC, rank) AS final_rank FROM f
 UNION ALL SELECT query, doc, rank, NULL, NULL, rank FROM h20 WHERE rank > 10""")
def _(t: Tables):
    out = fusion.rerank_fuse(with_reranker(t), "similarity", "text")
    return out.select("query", "doc", "rank", "rerank_rank", F.round("reranked_score", 6).alias("reranked_score"), "final_rank")


PENALTY = (*RERANK, """b0 AS (SELECT query, doc, score, status, family, min(score) OVER (PARTITION BY query) AS lo, max(score) OVER (PARTITION BY query) AS hi FROM h20),
b1 AS (SELECT *, CASE WHEN lo < 0 THEN -lo + 0.01 ELSE 0 END AS shift FROM b0),
b2 AS (SELECT *, round((score + shift) * CASE WHEN hi + shift > 1 THEN 1.0 / (hi + shift) ELSE 1 END, 12) AS orig FROM b1),
lead AS (SELECT * FROM (SELECT query, family, doc AS leader, orig AS ls, row_number() OVER (PARTITION BY query, family ORDER BY orig DESC, doc) AS r
 FROM b2 WHERE status = 'active') WHERE r = 1),
b3 AS (SELECT b.*, CASE WHEN status = 'superseded' THEN leader END AS superseded_by, CASE WHEN status = 'superseded' AND leader IS NOT NULL
 THEN greatest(0, least(orig - 2.0, greatest(0, ls - 0.1))) ELSE orig END AS ps FROM b2 b LEFT JOIN lead l ON l.query = b.query AND l.family = b.family),
b4 AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY orig DESC, doc) AS pre_rank,
 row_number() OVER (PARTITION BY query ORDER BY ps DESC, orig DESC, doc) AS final_rank FROM b3)""")


@query("supersession_penalty", W.cte(*PENALTY) + """SELECT query, doc, superseded_by, pre_rank, final_rank, round(greatest(0, least(1, round(ps, 4))), 4) AS final_score,
 (pre_rank <= 10 AND final_rank > 10 AND superseded_by IS NOT NULL AND EXISTS (SELECT 1 FROM b4 x WHERE x.query = b4.query AND x.doc = b4.superseded_by AND x.final_rank <= 3)) AS nearby_superseded
 FROM b4""")
def _(t: Tables):
    hits = with_reranker(t).select("query", "doc", "score", "status", "family")
    return fusion.supersession_penalty(hits).select("query", "doc", "superseded_by", "pre_rank", "final_rank",
                                                    "final_score", "nearby_superseded")


@query("nearby_superseded", W.cte(*PENALTY) + """SELECT query, doc, superseded_by FROM b4 WHERE pre_rank <= 3 AND final_rank > 3 AND superseded_by IS NOT NULL
 AND EXISTS (SELECT 1 FROM b4 x WHERE x.query = b4.query AND x.doc = b4.superseded_by AND x.final_rank <= 3)""")
def _(t: Tables):
    hits = with_reranker(t).select("query", "doc", "score", "status", "family")
    return fusion.supersession_penalty(hits, k=3).filter("nearby_superseded").select("query", "doc", "superseded_by")


@query("score_margin_and_spread", W.cte(*RERANK) + """SELECT query, count(*) AS n, round(max(CASE WHEN rank = 1 THEN score END), 6) AS top,
 round(max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END), 6) AS margin, round(stddev_pop(score), 6) AS stdev FROM h20 GROUP BY query""")
def _(t: Tables):
    shape = fusion.score_shape(with_reranker(t))
    return shape.select("query", "n", F.round("top", 6).alias("top"), F.round("margin", 6).alias("margin"),
                        F.round("stdev", 6).alias("stdev"))


@query("orphan_gate", W.cte(*BM25_TOP, *DENSE_TOP) + """, h AS (SELECT * FROM den WHERE rank <= 10),
 s AS (SELECT query, count(*) AS n, max(CASE WHEN rank = 1 THEN similarity END) AS top, max(CASE WHEN rank = 1 THEN doc END) AS td,
 max(CASE WHEN rank = 1 THEN similarity END) - max(CASE WHEN rank = 2 THEN similarity END) AS m, stddev_pop(similarity) AS sd FROM h GROUP BY query),
 c AS (SELECT b.query, n, m, sd, CASE WHEN n = 1 OR m < 0.20 THEN td IN (SELECT doc_id FROM labels) END AS corr FROM bq b LEFT JOIN s USING (query)),
 r AS (SELECT *, CASE WHEN n IS NULL THEN 'no_candidates' WHEN n = 1 AND NOT coalesce(corr, false) THEN 'single_candidate_no_corroboration' WHEN n = 1 THEN NULL
 WHEN m < 0.10 AND NOT coalesce(corr, false) THEN 'insufficient_margin' WHEN m >= 0.10 AND sd < 0.05 THEN 'flat_score_distribution' END AS reason FROM c)
 SELECT query, reason IS NOT NULL AS orphan, reason, round(CASE WHEN n > 1 THEN m END, 6) AS margin, round(CASE WHEN n > 1 THEN sd END, 6) AS stdev, corr AS corroborated FROM r""")
def _(t: Tables):
    hits = dense.dense_search(*text_vectors(t), 10).withColumnRenamed("similarity", "score")
    return fusion.orphan_gate(W.bench_queries(t), hits, t.labels.select(F.col("doc_id").alias("doc")))


@query("retrieval_recall_mrr", W.cte(*BM25_TOP, W.QRELS) + """, f AS (SELECT query, min(rank) AS fr FROM sparse JOIN qrels USING (query, doc) WHERE rank <= 5 GROUP BY query),
 p AS (SELECT b.query, b.kind, fr FROM bq b LEFT JOIN f USING (query))
 SELECT CASE WHEN grouping(kind) = 1 THEN 'OVERALL' ELSE kind END AS kind, count(*) AS n, round(avg(CASE WHEN fr <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1,
 round(avg(CASE WHEN fr <= 3 THEN 1.0 ELSE 0 END), 6) AS recall_3, round(avg(CASE WHEN fr <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5,
 round(avg(coalesce(1.0 / fr, 0)), 6) AS mrr FROM p GROUP BY GROUPING SETS ((kind), ())""")
def _(t: Tables):
    q = W.bench_queries(t)
    hits = bm25_search(q, build_bm25(W.doc_corpus(t), "doc", "text"), 5, "query", "text")
    return metrics.ir_metrics(q, hits, W.qrels(t))


@query("retrieval_ndcg", W.cte(*BM25_TOP, W.QRELS) + """, g AS (SELECT query, min(doc) AS doc FROM qrels GROUP BY query),
 f AS (SELECT query, min(rank) AS fr FROM sparse JOIN g USING (query, doc) WHERE rank <= 5 GROUP BY query),
 p AS (SELECT b.query, b.kind, fr FROM bq b LEFT JOIN f USING (query))
 SELECT CASE WHEN grouping(kind) = 1 THEN 'OVERALL' ELSE kind END AS kind, count(*) AS n,
 round(avg(CASE WHEN fr <= 1 THEN 1.0 ELSE 0 END), 6) AS precision_1, round(avg(CASE WHEN fr <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1,
 round(avg(CASE WHEN fr <= 1 THEN 1 / log2(fr + 1) ELSE 0 END), 6) AS ndcg_1,
 round(avg(CASE WHEN fr <= 5 THEN 1.0 ELSE 0 END), 6) AS precision_5, round(avg(CASE WHEN fr <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5,
 round(avg(CASE WHEN fr <= 5 THEN 1 / log2(fr + 1) ELSE 0 END), 6) AS ndcg_5 FROM p GROUP BY GROUPING SETS ((kind), ())""")
def _(t: Tables):
    q = W.bench_queries(t)
    hits = bm25_search(q, build_bm25(W.doc_corpus(t), "doc", "text"), 5, "query", "text")
    gold = W.qrels(t).groupBy("query").agg(F.min("doc").alias("doc"))
    return metrics.ndcg_metrics(q, hits, gold)


@query("compare_two_runs", W.cte(*BM25_TOP, *DENSE_TOP, W.QRELS) + """, a AS (SELECT query, max(CASE WHEN rank = 1 AND doc IN (SELECT doc FROM qrels x WHERE x.query = s.query) THEN 1 ELSE 0 END) AS h FROM sparse s GROUP BY query),
 b AS (SELECT query, max(CASE WHEN rank = 1 AND doc IN (SELECT doc FROM qrels x WHERE x.query = s.query) THEN 1 ELSE 0 END) AS h FROM den s GROUP BY query),
 p AS (SELECT avg(coalesce(a.h, 0)) AS p_a, avg(coalesce(b.h, 0)) AS p_b, count(*) AS n FROM bq LEFT JOIN a USING (query) LEFT JOIN b USING (query))
 SELECT round(p_a, 6) AS p_a, round(p_b, 6) AS p_b, round(p_a - p_b, 6) AS gap, round(sqrt((p_a * (1 - p_a) + p_b * (1 - p_b)) / n), 6) AS se,
 abs(p_a - p_b) < 2 * sqrt((p_a * (1 - p_a) + p_b * (1 - p_b)) / n) AS within_noise FROM p""")
def _(t: Tables):
    q = W.bench_queries(t)
    rel = W.qrels(t)

    def first_hit(hits):
        ranked = metrics.first_relevant_rank(q, hits.filter("rank = 1"), rel)
        return ranked.select("query", F.coalesce(F.col("first_rank") == 1, F.lit(False)).alias("hit"))

    return metrics.compare_runs(first_hit(sparse50(t)), first_hit(dense50(t)))


@query("bm25_minmax_scaled", W.cte(*BM25_TOP) + """SELECT query, doc, round(CASE WHEN hi - lo > 1e-6 THEN (score - lo) / (hi - lo + 1e-6) ELSE 0.5 END, 6) AS scaled
 FROM (SELECT *, min(score) OVER (PARTITION BY query) AS lo, max(score) OVER (PARTITION BY query) AS hi FROM sparse)""")
def _(t: Tables):
    return minmax(sparse50(t), ["query"], "score", "scaled").select("query", "doc", F.round("scaled", 6).alias("scaled"))


@query("bm25_max_scaled", W.cte(*BM25_TOP) + "SELECT query, doc, round(score / max(score) OVER (PARTITION BY query), 6) AS scaled FROM sparse")
def _(t: Tables):
    return maxnorm(sparse50(t), ["query"], "score", "scaled").select("query", "doc", F.round("scaled", 6).alias("scaled"))


@query("bm25_full_rank", W.cte(*BM25) + "SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM score")
def _(t: Tables):
    s = bm25_scores(W.bench_queries(t), build_bm25(W.doc_corpus(t), "doc", "text"), "query", "text")
    return exact_rank(s, ["query"], ["-score", "doc"]).select("query", "doc", "rank")


@query("candidate_pool_depth", "SELECT count(*) AS n, greatest(30, least(120, floor(sqrt(count(*)))::BIGINT * 3)) AS pool FROM documents")
def _(t: Tables):
    n = t.documents.count()
    return t.documents.agg(F.count(F.lit(1)).alias("n")).withColumn("pool", F.lit(fusion.candidate_pool_size(n)).cast("bigint"))


@query("candidate_pool_dump", W.cte(*BM25_TOP) + """SELECT query, count(*) AS n, string_agg(doc::VARCHAR, ',' ORDER BY rank) AS docs FROM sparse WHERE rank <= 20 GROUP BY query""")
def _(t: Tables):
    hits = topk(sparse50(t).drop("rank"), ["query"], ["-score", "doc"], 20)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda s: s["doc"].cast("string")), ",")
    return hits.groupBy("query").agg(F.count(F.lit(1)).alias("n"), listed.alias("docs"))  # twenty rows per query


@query("confidence_levels", W.cte(*BM25_TOP) + """SELECT query, doc, CASE WHEN score - 20 >= 0 THEN 'strong' WHEN score - 20 <= -6 THEN 'none' ELSE 'uncertain' END AS level FROM sparse WHERE rank = 1""")
def _(t: Tables):
    first = sparse50(t).filter("rank = 1")
    return first.select("query", "doc", fusion.confidence_level(F.col("score") - 20).alias("level"))


@query("display_scores", W.cte(*RERANK) + """SELECT query, doc, CASE WHEN hi - lo <= 0 THEN 1.0 ELSE round(ts * (0.35 + 0.65 * (score - lo) / (hi - lo)), 4) END AS display_score
 FROM (SELECT *, min(score) OVER (PARTITION BY query) AS lo, max(score) OVER (PARTITION BY query) AS hi,
 max(CASE WHEN rank = 1 THEN least(greatest(similarity, 0), 1) END) OVER (PARTITION BY query) AS ts FROM h20)""")
def _(t: Tables):
    return fusion.display_score(with_reranker(t), "score", "similarity").select("query", "doc", "display_score")
