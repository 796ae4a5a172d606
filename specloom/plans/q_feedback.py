"""Interaction-log and learning queries over events, documents and benchmark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.functions import scoring as S
from specloom.operators import feedback as B
from specloom.operators import ranker as L
from specloom.operators.overlap import dispute_lift, scope_overlap
from specloom.operators.ranking import spread, topk
from specloom.plans import views as W
from specloom.plans.q_retrieval import BM25_TOP, DENSE_TOP, dense50, sparse50
from specloom.plans.registry import Tables, query
from specloom.session import cut_lineage


def interactions(t: Tables):
    """Events as interactions: a purchase accepts, a signup corrects, anything else rejects."""
    e, k = F.col("event_type"), F.col("event_id")

    def cand(i, shift):
        return F.struct(F.concat(F.lit("S"), (k * shift + i) % 200).alias("id"), (F.lit(1.0) / i).alias("final_score"), F.lit(i).alias("rank"))

    return t.events.select(
        k, e, "user_id", F.concat(F.lit("query "), F.col("user_id") % 60).alias("query"), F.array(cand(1, 1), cand(2, 7), cand(3, 13)).alias("candidates_shown"),
        F.when(e == "purchase", F.concat(F.lit("S"), (k + 1) % 200)).alias("chosen_id"),
        F.when(e == "purchase", "accept").when(e == "signup", "correct").otherwise("reject").alias("action"),
        F.when(e == "signup", F.concat(F.lit("S"), k * 17 % 300)).alias("corrected_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.lit("live").alias("source"))


LOGS = """lg AS (SELECT event_id, event_type, user_id, concat('query ', user_id % 60) AS query, [concat('S', (event_id + 1) % 200), concat('S', (event_id * 7 + 2) % 200), concat('S', (event_id * 13 + 3) % 200)] AS cands,
 CASE event_type WHEN 'purchase' THEN concat('S', (event_id + 1) % 200) WHEN 'signup' THEN concat('S', event_id * 17 % 300) END AS sel, CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'signup' THEN 'correct' ELSE 'reject' END AS action FROM events),
sh AS (SELECT id, count(*) AS n_shown FROM (SELECT unnest(cands) AS id FROM lg) GROUP BY id), ac AS (SELECT sel AS id, count(*) AS n_accepted FROM lg WHERE sel IS NOT NULL GROUP BY sel)"""


@query("acceptance_rates", W.cte(LOGS) + "SELECT id, n_shown, coalesce(n_accepted, 0) AS n_accepted, round(coalesce(n_accepted, 0) / n_shown, 6) AS rate FROM sh LEFT JOIN ac USING (id)")
def _(t: Tables):
    return B.acceptance_rate(interactions(t)).withColumn("rate", F.round("rate", 6))


@query("feedback_labels", W.cte(LOGS) + """SELECT query, id, max(label)::INT AS label FROM (SELECT query, sel AS id, 1 AS label FROM lg WHERE sel IS NOT NULL UNION ALL SELECT query, unnest(cands), 0 FROM lg WHERE action = 'reject')
 WHERE id IN (SELECT concat('S', p_partkey) FROM part WHERE p_partkey % 3 > 0) GROUP BY query, id""")
def _(t: Tables):
    corpus = t.part.filter("p_partkey % 3 > 0").select(F.concat(F.lit("S"), "p_partkey").alias("id"))
    return B.feedback_labels(interactions(t), corpus)


@query("interaction_validity", "SELECT event_id, CASE event_type WHEN 'purchase' THEN event_id % 10 > 0 WHEN 'signup' THEN true WHEN 'error' THEN false ELSE true END AS valid FROM events")
def _(t: Tables):
    x = interactions(t)
    act = F.when(F.col("event_type") == "error", "ignore").otherwise(F.col("action"))
    chosen = F.when(F.col("event_id") % 10 > 0, F.col("chosen_id")).otherwise(" ")
    return x.select("event_id", S.valid_interaction(act, chosen, "corrected_id").alias("valid"))


def query_sets(t: Tables):
    """(training, evaluation) queries: those asked at least as often as the mean query, and the rarer ones."""
    asked = interactions(t).groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    often = F.col("n") >= asked.agg(F.avg("n").alias("m")).select("m").scalar()
    return asked.filter(often).select(F.concat("query", F.lit(" ")).alias("query")), asked.filter(~often).select("query")


RARE = """WITH asked AS (SELECT concat('query ', user_id % 60) AS query, count(*) AS n FROM events GROUP BY 1), rare AS (SELECT query FROM asked WHERE n < (SELECT avg(n) FROM asked))
"""


@query("leaked_queries", RARE + "SELECT query FROM rare")
def _(t: Tables):
    return B.leakage(interactions(t), query_sets(t)[1])


@query("log_integrity", RARE + """, c AS (SELECT (SELECT count(*) FROM events) AS n, (SELECT count(*) FROM rare) AS r)
 SELECT 'rare queries held out' AS given, n AS n_lines, r AS n_leaked, r AS n_extra, r = 0 AS passed FROM c UNION ALL SELECT 'other queries held out', n, 0, 0, true FROM c
 UNION ALL SELECT 'lines missing', n, 0, 0, n = (SELECT count(*) FROM orders) FROM c""")
def _(t: Tables):
    logs = interactions(t)
    train, rare = query_sets(t)
    every, other = logs.select("query").distinct(), t.supplier.select(F.col("s_name").alias("query"))
    n = t.events.count()
    cases = {"rare queries held out": (train, rare, n), "other queries held out": (every, other, n), "lines missing": (every, other, t.orders.count())}
    return reduce(DataFrame.unionByName, [B.log_integrity(logs, *sets).withColumn("given", F.lit(name)) for name, sets in cases.items()])


CAND = (*BM25_TOP, *DENSE_TOP, W.QRELS, """cand AS (SELECT query, doc, rank FROM sparse WHERE rank <= 20), cps AS (SELECT doc, lang AS category, source, (doc % 30) AS a FROM dc),
rts AS (SELECT doc_id AS doc, quality / 2.0 AS rate FROM labels),
f0 AS (SELECT c.query, c.doc, coalesce(d.similarity, 0) AS dense_score, s.score AS bm25, coalesce(CASE WHEN d.rank <= 5 THEN d.similarity END, -10) AS cross_encoder_score FROM cand c LEFT JOIN den d USING (query, doc) LEFT JOIN sparse s USING (query, doc)),
f1 AS (SELECT *, CASE WHEN hi - lo > 1e-6 THEN (bm25 - lo) / (hi - lo + 1e-6) ELSE 0.5 END AS bn FROM (SELECT *, min(bm25) OVER (PARTITION BY query) AS lo, max(bm25) OVER (PARTITION BY query) AS hi FROM f0))""")


def candidates(t: Tables):
    return cut_lineage(sparse50(t)), cut_lineage(dense50(t).withColumnRenamed("similarity", "score"))


def corpus_features(t: Tables):
    d = W.doc_corpus(t)
    return d.select("doc", F.col("lang").alias("category"), F.array("lang", F.lit("the of and")).alias("keywords"),
                    F.concat(F.col("doc") % 30 + 1990, F.lit("-01-01")).alias("last_amended"))


def features(t: Tables, found=None):
    sp, de = found or candidates(t)
    tables = {"dense": de, "bm25": sp, "cross": de.filter("rank <= 5")}
    rates = t.labels.select(F.col("doc_id").alias("doc"), (F.col("quality") / 2.0).alias("rate"))
    return L.ltr_features(sp.filter("rank <= 20"), tables, W.bench_queries(t), corpus_features(t), rates, 2019)


@query("ranking_features", W.cte(*CAND) + """SELECT f.query, f.doc, round(dense_score, 6) AS dense_score, round(bn, 6) AS bm25_score_normalized, round(cross_encoder_score, 6) AS cross_encoder_score,
 round(greatest(0, 1 - greatest(0, 2019 - (1990 + f.doc % 30)) / 10.0), 6) AS recency_score, 0.5::DOUBLE AS category_match,
 least(1, (CASE WHEN contains(lower(b.text), c.category) THEN 1.0 ELSE 0 END + CASE WHEN contains(lower(b.text), 'the of and') THEN 1.0 WHEN contains(lower(b.text), 'the') AND contains(lower(b.text), 'and') THEN 0.5 ELSE 0 END) / 2) AS keyword_overlap,
 coalesce(rate, 0) AS historical_acceptance_rate FROM f1 f JOIN bq b USING (query) JOIN cps c USING (doc) LEFT JOIN rts USING (doc)""")
def _(t: Tables):
    f = features(t)
    return f.select("query", "doc", *[F.round(c, 6).alias(c) for c in L.FEATURES])


@query("missing_scores_filled", W.cte(*CAND) + "SELECT query, doc, round(dense_score, 6) AS dense, round(bm25, 6) AS bm25, round(cross_encoder_score, 6) AS cross FROM f0".replace(" AS cross ", ' AS "cross" '))
def _(t: Tables):
    sp, de = candidates(t)
    out = L.attach_scores(sp.filter("rank <= 20").select("query", "doc"), {"dense": de, "bm25": sp, "cross": de.filter("rank <= 5")}, {"dense": 0, "bm25": 0, "cross": -10})
    return out.select("query", "doc", *[F.round(c, 6).alias(c) for c in ("dense", "bm25", "cross")])


GOLD = "gold AS (SELECT query, min(doc) AS doc FROM qrels GROUP BY query)"
LAB = (*CAND, GOLD, """lab AS (SELECT p.query, p.doc, CASE WHEN p.doc = g.doc THEN 3 WHEN c.lang = gc.lang THEN 1 ELSE 0 END AS label FROM (SELECT query, doc FROM cand UNION SELECT query, doc FROM gold) p
 JOIN gold g USING (query) JOIN dc c ON c.doc = p.doc JOIN dc gc ON gc.doc = g.doc)""")


def labels(t: Tables, sparse=None):
    gold = W.qrels(t).groupBy("query").agg(F.min("doc").alias("doc"))
    cands = (sparse50(t) if sparse is None else sparse).filter("rank <= 20")
    return L.graded_labels(cands, gold, W.doc_corpus(t).select("doc", F.col("lang").alias("category")))


@query("graded_labels", W.cte(*LAB) + "SELECT query, doc, label FROM lab")
def _(t: Tables):
    return labels(t)


@query("label_distribution", W.cte(*LAB) + """SELECT sum(l0)::BIGINT AS label_0, sum(l1)::BIGINT AS label_1, sum(l3)::BIGINT AS label_3, count(*) AS queries, min(n) AS min_size, max(n) AS max_size, round(avg(n), 6) AS mean_size
 FROM (SELECT query, count(*) AS n, count(*) FILTER (label = 0) AS l0, count(*) FILTER (label = 1) AS l1, count(*) FILTER (label = 3) AS l3 FROM lab GROUP BY query)""")
def _(t: Tables):
    return L.label_stats(labels(t))


@query("feature_correlation", "SELECT a, b, CASE WHEN a = 'flat' OR b = 'flat' THEN (a = b)::INT::DOUBLE ELSE round(r, 6) END AS r FROM (SELECT 'q' AS a, 'q' AS b, corr(l_quantity, l_quantity) AS r FROM lineitem UNION ALL SELECT 'q', 'p', corr(l_quantity, l_extendedprice) FROM lineitem UNION ALL SELECT 'p', 'q', corr(l_extendedprice, l_quantity) FROM lineitem UNION ALL SELECT 'p', 'p', corr(l_extendedprice, l_extendedprice) FROM lineitem UNION ALL SELECT unnest(['q','p','flat','flat','flat']), unnest(['flat','flat','flat','q','p']), 0)")
def _(t: Tables):
    f = t.lineitem.select(F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.lit(1.0).alias("flat"))
    return L.correlation_matrix(f, ["q", "p", "flat"])


@query("fold_statistics", "SELECT count(*) AS folds, round(avg(s_acctbal), 6) AS mean, round(stddev_pop(s_acctbal), 6) AS std FROM supplier")
def _(t: Tables):
    return L.cv_summary(t.supplier, "s_acctbal")


RUNS = """SELECT c_custkey AS id, c_acctbal / 10000 AS candidate, 0.4 + c_nationkey / 100.0 AS baseline, CASE WHEN c_custkey % 3 > 0 THEN 0.6 END AS cv_mean, 0.1 AS cv_std, c_custkey % 25 AS distinct_queries, CASE WHEN c_custkey % 5 > 0 THEN 0.5 END AS current FROM customer"""


def runs(t: Tables):
    k = F.col("c_custkey")
    return t.customer.select(k.alias("id"), (F.col("c_acctbal") / 10000).alias("candidate"), (F.col("c_nationkey") / 100.0 + 0.4).alias("baseline"),
                             F.when(k % 3 > 0, 0.6).alias("cv_mean"), F.lit(0.1).alias("cv_std"), (k % 25).alias("distinct_queries"), F.when(k % 5 > 0, 0.5).alias("current"))


@query("promotion_gate", f"""SELECT id, round(required, 6) AS required, CASE WHEN cv_mean IS NULL THEN 'baseline_only' WHEN baseline >= cv_mean - cv_std THEN 'baseline' ELSE 'cv_lower_bound' END AS driver, candidate >= required + 0.05 AS promoted, round(candidate - required, 6) AS margin
 FROM (SELECT *, greatest(baseline, coalesce(cv_mean - cv_std, baseline)) AS required FROM ({RUNS}))""")
def _(t: Tables):
    return L.promotion_decision(runs(t), 0.05).select("id", F.round("required", 6).alias("required"), "driver", "promoted", F.round("margin", 6).alias("margin"))


@query("retrain_decision", f"""SELECT id, reason, reason IN ('first_run_auto_promotion', 'candidate_equal_or_better') AS promoted FROM (SELECT id, CASE WHEN distinct_queries < 10 THEN 'insufficient_data' WHEN "current" IS NULL THEN 'first_run_auto_promotion'
 WHEN candidate >= "current" THEN 'candidate_equal_or_better' ELSE 'candidate_worse' END AS reason FROM ({RUNS.replace('AS current', 'AS "current"')}))""")
def _(t: Tables):
    return L.retrain_decision(runs(t)).select("id", "reason", "promoted")


@query("stratified_sample_sizes", "SELECT c_mktsegment AS segment, least(25, count(*)) AS n FROM customer GROUP BY 1")
def _(t: Tables):
    s = B.stratified_sample(t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment")), "segment", "c_custkey", 25, 7)
    return s.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@query("kfold_sizes", "SELECT fold::INT AS fold, (SELECT count(DISTINCT user_id) FROM events) // 5 + (fold < (SELECT count(DISTINCT user_id) FROM events) % 5)::INT AS users FROM range(5) t(fold)")
def _(t: Tables):
    f = B.kfold(t.events.select("user_id", "event_id"), "user_id", 5, 42)
    return f.groupBy("fold").agg(F.countDistinct("user_id").alias("users"))


@query("group_split_sizes", "WITH n AS (SELECT count(DISTINCT user_id) AS n FROM events) SELECT 'validation' AS part, greatest(1, round(n * 0.2))::BIGINT AS users FROM n UNION ALL SELECT 'train', n - greatest(1, round(n * 0.2))::BIGINT FROM n")
def _(t: Tables):
    f = B.group_split(t.events.select("user_id", "event_id"), "user_id", 0.2, 42)
    return f.groupBy("part").agg(F.countDistinct("user_id").alias("users"))


@query("synthetic_interactions")
def _(t: Tables):
    gold = W.bench_queries(t).select("query", (F.col("query") % 20).alias("doc"))
    return B.synth_interactions(sparse50(t).filter("rank <= 10"), gold, 0.1, 42)


@query("evaluation_set")
def _(t: Tables):
    return B.build_eval_set(W.standards(t), 300, 20260921)


def labelled(t: Tables):
    found = candidates(t)  # searched once for both
    return cut_lineage(features(t, found).join(labels(t, found[0]), ["query", "doc"]))


@query("ranker_scores")
def _(t: Tables):
    data = labelled(t)
    scored = L.score_ranker(L.train_ranker(data), data)
    return topk(scored.select("query", "doc", "label", F.round("score", 6).alias("score")), ["query"], ["-score", "doc"], 10)


@query("ranker_cross_validation")
def _(t: Tables):
    return L.cross_validate(labelled(t), 3)


@query("scope_overlap", """WITH s0 AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '([a-zA-Z0-9]+)', 1))) AS words FROM documents),
 s AS (SELECT min(doc_id) AS id, words, len(words) AS n FROM s0 WHERE len(words) > 0 GROUP BY words), w AS (SELECT id, n, unnest(words) AS word FROM s),
 p AS (SELECT a.id, b.id AS other, round(count(*) / (a.n + b.n - count(*)), 9) AS overlap FROM w a JOIN w b USING (word) WHERE a.id <> b.id GROUP BY a.id, b.id, a.n, b.n)
 SELECT id, other, round(overlap, 6) AS overlap, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY overlap DESC, other) AS rank FROM p WHERE overlap >= 0.5) WHERE rank <= 5""")
def _(t: Tables):
    out = scope_overlap(spread(t.documents, "doc_id"), 0.5, 5, "doc_id", "text")
    return out.select("id", "other", F.round("overlap", 6).alias("overlap"), "rank")


@query("dispute_lift", """WITH c AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey AS record FROM lineitem), o AS (SELECT l_orderkey AS doc, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS bad FROM lineitem GROUP BY l_orderkey),
 h AS (SELECT c.doc, record, bad FROM c JOIN o USING (doc)), b AS (SELECT avg(bad) AS r FROM o),
 x AS (SELECT record AS first, NULL::BIGINT AS second, count(*) AS documents, sum(bad)::BIGINT AS disputed FROM h GROUP BY record
 UNION ALL SELECT a.record, z.record, count(*), sum(a.bad)::BIGINT FROM h a JOIN h z ON a.doc = z.doc AND a.record < z.record GROUP BY a.record, z.record)
 SELECT first, second, documents, disputed, round(disputed / documents / r, 6) AS lift FROM x, b WHERE documents >= 5""")
def _(t: Tables):
    li = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").cast("bigint").alias("record"), (F.col("l_returnflag") == "R").alias("bad"))
    return dispute_lift(li.select("doc", "record"), li.select("doc", "bad"))


@query("ranker_scores_listwise")
def _(t: Tables):
    data = labelled(t)
    scored = L.score_ranker(L.train_ranker(data, "listwise"), data)
    return topk(scored.select("query", "doc", "label", F.round("score", 6).alias("score")), ["query"], ["-score", "doc"], 10)


@query("ranker_tree_contributions")
def _(t: Tables):
    data = labelled(t)
    return L.feature_contributions(L.train_ranker(data, "trees"), data)


@query("ranker_contributions")
def _(t: Tables):
    data = labelled(t)
    return L.feature_contributions(L.train_ranker(data), data)


@query("full_retrieval", W.cte(*BM25_TOP, *DENSE_TOP) + """, fu AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM (SELECT query, doc, round(sum(1.0 / (60 + rank)), 12) AS score FROM (SELECT query, doc, rank FROM sparse UNION ALL SELECT query, doc, rank FROM den) GROUP BY query, doc)),
 c0 AS (SELECT f.query, f.doc, coalesce(d.similarity, 0) AS dn, coalesce(s.score, 0) AS bm, CASE WHEN f.rank <= 10 THEN m.similarity ELSE -10 END AS ce FROM fu f LEFT JOIN den d USING (query, doc) LEFT JOIN sparse s USING (query, doc) JOIN sims m USING (query, doc) WHERE f.rank <= 20),
 c1 AS (SELECT *, min(bm) OVER (PARTITION BY query) AS lo0, max(bm) OVER (PARTITION BY query) AS hi0 FROM c0),
 c2 AS (SELECT query, doc, ce, 0.3 * dn + 0.2 * CASE WHEN hi0 - lo0 > 1e-6 THEN (bm - lo0) / (hi0 - lo0 + 1e-6) ELSE 0.5 END + 0.5 * ce AS score, status, family FROM c1 JOIN dc USING (doc)),
 b0 AS (SELECT *, min(score) OVER (PARTITION BY query) AS lo, max(score) OVER (PARTITION BY query) AS hi FROM c2), b1 AS (SELECT *, CASE WHEN lo < 0 THEN -lo + 0.01 ELSE 0 END AS shift FROM b0),
 b2 AS (SELECT *, round((score + shift) * CASE WHEN hi + shift > 1 THEN 1.0 / (hi + shift) ELSE 1 END, 12) AS orig FROM b1),
 ld AS (SELECT * FROM (SELECT query, family, doc AS leader, orig AS ls, row_number() OVER (PARTITION BY query, family ORDER BY orig DESC, doc) AS r FROM b2 WHERE status = 'active') WHERE r = 1),
 b3 AS (SELECT b.*, CASE WHEN status = 'superseded' THEN leader END AS sb, CASE WHEN status = 'superseded' AND leader IS NOT NULL THEN greatest(0, least(orig - 2.0, greatest(0, ls - 0.1))) ELSE orig END AS ps FROM b2 b LEFT JOIN ld l ON l.query = b.query AND l.family = b.family),
 b4 AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ps DESC, orig DESC, doc) AS fr FROM b3)
 SELECT a.query, a.doc, a.fr AS final_rank, round(greatest(0, least(1, round(a.ps, 4))), 4) AS final_score, a.sb AS superseded_by, CASE WHEN z.ce >= 0 THEN 'strong' WHEN z.ce <= -6 THEN 'none' ELSE 'uncertain' END AS level FROM b4 a JOIN b4 z ON z.query = a.query AND z.fr = 1 WHERE a.fr <= 10""")
def _(t: Tables):
    from specloom.operators.bm25 import build_bm25
    from specloom.plans.q_retrieval import text_vectors
    from specloom.plans.search import SearchConfig, retrieve
    d = W.doc_corpus(t)
    corpus = d.select("doc", "status", "family").join(corpus_features(t), "doc")
    rates = t.labels.select(F.col("doc_id").alias("doc"), (F.col("quality") / 2.0).alias("rate"))
    qv, dv = text_vectors(t)
    out = retrieve(W.bench_queries(t), qv, dv, build_bm25(d, "doc", "text"), corpus, rates, SearchConfig(year=2019))
    return out.select("query", "doc", "final_rank", "final_score", "superseded_by", "level")
