"""The whole retrieval request for a table of queries, as one composition of operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.functions import scoring as S
from specloom.functions import vocab as V
from specloom.operators import dense, fusion, ranker
from specloom.operators.bm25 import Bm25Index, bm25_search
from specloom.session import cut_lineage


@dataclass
class SearchConfig:
    pool: int = 50            # candidates each channel contributes
    fused: int = 20           # candidates after rank fusion
    rerank_depth: int = V.RERANK_DEPTH
    year: int = 2024          # reference year of the recency feature
    penalty: float = 2.0
    top: int = 10


def retrieve(queries: DataFrame, q_vecs: DataFrame, d_vecs: DataFrame, index: Bm25Index, corpus: DataFrame, rates: DataFrame,
             config: SearchConfig, cross_scores=None, model=None, lexicon=None) -> DataFrame:
    """Ranked results (query, doc, final_rank, final_score, level, superseded_by, …).

    Both channels, rank fusion, reranker scores for the first candidates, the seven features, the
    trained ranker or the fallback formula, the supersession penalty, and the confidence level of
    each query. ``corpus(doc, status, family, category, keywords, last_amended)``;
    ``cross_scores(pairs) -> (query, doc, score)`` is the pluggable reranker, by default the
    vectors' own similarity. The pools are written once because four later steps read them.
    """
    sparse = cut_lineage(bm25_search(queries, index, config.pool, "query", "text"))
    close = cut_lineage(dense.dense_search(q_vecs, d_vecs, config.pool))
    fused = cut_lineage(fusion.rrf([close, sparse], top=config.fused))
    head = fused.filter(F.col("rank") <= config.rerank_depth).select("query", "doc")
    if cross_scores is None:
        cross = dense.pair_similarity(head, q_vecs, d_vecs).withColumnRenamed("similarity", "score")
    else:
        cross = cross_scores(head)
    tables = {"dense": close.withColumnRenamed("similarity", "score"), "bm25": sparse, "cross": cross}
    features = ranker.ltr_features(fused, tables, queries, corpus, rates, config.year, lexicon)
    if model is None:
        scored = features.withColumn("score", S.fallback_score("dense_score", "bm25_score_normalized", "cross_encoder_score"))
    else:
        scored = ranker.score_ranker(model, features)
    scored = scored.join(corpus.select("doc", "status", "family"), "doc")
    out = fusion.supersession_penalty(scored.select("query", "doc", "score", "status", "family", "cross_encoder_score"), config.penalty, config.top)
    first = out.filter("final_rank = 1").select("query", fusion.confidence_level("cross_encoder_score").alias("level"))
    return out.join(first, "query").filter(F.col("final_rank") <= config.top)
