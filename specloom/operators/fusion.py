"""Fusion of retrieval channels, rerank fusion, supersession handling and quality gates."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.functions import vocab as V
from specloom.functions.text import is_latin
from specloom.operators import blocked, dense
from specloom.operators.bm25 import Bm25Index, query_terms
from specloom.operators.patterns import pattern_hits
from specloom.operators.ranking import maxnorm, spread_join, topk
from specloom.session import cut_lineage


def rrf(rankings: list[DataFrame], k: int = V.RRF_K, top: int = 20) -> DataFrame:
    """Reciprocal rank fusion of (query, doc, rank) lists over their union."""
    votes = [r.select("query", "doc", (F.lit(1.0) / (F.col("rank") + k)).alias("vote")) for r in rankings]
    fused = reduce(DataFrame.unionByName, votes).groupBy("query", "doc").agg(F.round(F.sum("vote"), 12).alias("score"))
    return topk(fused, ["query"], ["-score", "doc"], top)


def weighted_fusion(dense_hits: DataFrame, sparse_hits: DataFrame, top: int,
                    dense_weight: float = 0.6, sparse_weight: float = 0.4) -> DataFrame:
    """Weighted sum of max-normalised scores over the union of two (query, doc, score) lists."""
    parts = []
    for hits, weight in ((dense_hits, dense_weight), (sparse_hits, sparse_weight)):
        parts.append(maxnorm(hits.select("query", "doc", "score"), ["query"], "score", "n").select(
            "query", "doc", (F.col("n") * weight).alias("part")))
    fused = parts[0].unionByName(parts[1]).groupBy("query", "doc").agg(F.round(F.sum("part"), 9).alias("score"))
    return topk(fused, ["query"], ["-score", "doc"], top)


def alias_hits(queries: DataFrame, aliases: DataFrame, longest: int = 8) -> DataFrame:
    """Whole-phrase alias hits as (query, doc, alias_score).

    ``queries(query, text)``, ``aliases(doc, alias)``: a phrase occurs if, padded with spaces, it stands anywhere in the lower-cased,
    padded text, that is, if the pieces between its spaces follow one another among those of the text. So the runs of a text's pieces meet the distinct
    phrases by equality, at most ``longest`` pieces long; a longer phrase meets them by its first pieces and is looked for in the text then.
    """
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    pieces = lambda c: F.split(c, " ", -1)
    named = cut_lineage(aliases.filter(F.col("alias") != "").select("doc", "alias"))  # read three times below
    sized = named.select("alias").distinct().withColumn("n", F.least(F.size(pieces(F.col("alias"))), F.lit(longest)))
    phrases = cut_lineage(sized.select("alias", "n", F.array_join(F.slice(pieces(F.col("alias")), F.lit(1), F.col("n")), " ").alias("run")))
    lengths = phrases.agg(F.collect_set("n").alias("l")).select("l").scalar()  # at most ``longest`` numbers

    texts = queries.select("query", F.lower("text").alias("text")).filter(F.col("text").isNotNull())
    cut = texts.select("query", pieces(F.col("text")).alias("ws")).withColumn("n", F.explode(lengths)).filter(F.size("ws") >= F.col("n"))
    runs = F.transform(F.sequence(F.lit(1), F.size("ws") - F.col("n") + 1), lambda i: F.array_join(F.slice("ws", i, F.col("n")), " "))
    found = cut_lineage(cut.select("query", "n", F.explode_outer(F.array_distinct(runs)).alias("run")).join(phrases, ["n", "run"]))
    whole = F.col("alias") == F.col("run")
    longer = found.filter(~whole).join(texts, "query").filter(padded(F.col("text")).contains(padded(F.col("alias"))))
    hits = cut_lineage(found.filter(whole).select("query", "alias").unionByName(longer.select("query", "alias")).distinct())

    scored = spread_join(named, hits, ["alias"], "doc").withColumn("s", F.length("alias") / 40.0 + 1.0)
    return scored.groupBy("query", "doc").agg(F.max("s").alias("alias_score"))


def designation_hits(queries: DataFrame, designations: DataFrame) -> DataFrame:
    """Number of a record's designations that occur anywhere in the query: (query, doc, designation_hits)."""
    named = designations.filter(F.col("designation") != "").select("doc", F.col("designation").alias("pattern"))
    hits = pattern_hits(queries.select("query", F.lower("text").alias("text")), named)
    return named.join(hits, "pattern").groupBy("query", "doc").agg(F.count(F.lit(1)).alias("designation_hits"))


def fused_depth(k: int) -> int:
    """How deep each channel must be read so that no unread document can enter the top ``k``.

    A document below depth M in both channels and without a bonus scores at most
    (w + 1)/(60 + M + 1). The k best semantic documents score at least 0.6/(60 + k) each.
    """
    worst_kept = V.SUPERSEDED_PENALTY / (V.RRF_K + k)
    return math.ceil((V.LEXICAL_WEIGHT + 1.0) / worst_kept) - V.RRF_K


def fused_search(queries: DataFrame, corpus: DataFrame, index: Bm25Index, q_vecs: DataFrame, d_vecs: DataFrame,
                 k: int, aliases: DataFrame | None = None, designations: DataFrame | None = None) -> DataFrame:
    """Full-corpus weighted rank fusion with alias and designation bonuses and the status penalty.

    ``queries(query, text)``, ``corpus(doc, status)``. Ranks are those of the whole corpus, but
    only documents that can reach the top ``k`` are listed: the first ``fused_depth(k)`` of each
    channel plus every document with a bonus. Both channels multiply blocks of queries with blocks of documents; the ranks of
    the listed documents are counted block by block.
    """
    depth = fused_depth(k)
    asked = cut_lineage(query_terms(queries, "query", "text", index.variant))
    top_semantic = dense.dense_search(q_vecs, d_vecs, depth).select("query", "doc")
    top_lexical = blocked.first_ranks(index, asked, corpus.select("doc"), depth).select("query", "doc")
    # each is read twice below
    alias = cut_lineage(alias_hits(queries, aliases)) if aliases is not None else None
    designation = cut_lineage(designation_hits(queries, designations)) if designations is not None else None
    pools = [top_semantic, top_lexical] + [b.select("query", "doc") for b in (alias, designation) if b is not None]
    pool = reduce(DataFrame.unionByName, pools).distinct()
    pool = cut_lineage(dense.pair_similarity(pool, q_vecs, d_vecs))
    pool = cut_lineage(dense.similarity_rank(pool, q_vecs, d_vecs))
    pool = blocked.counted_ranks(index, asked, corpus.select("doc"), pool)
    if alias is not None:
        pool = pool.join(alias, ["query", "doc"], "left")
    if designation is not None:
        pool = pool.join(designation, ["query", "doc"], "left")
    alias_score = F.coalesce("alias_score", F.lit(0.0)) if alias is not None else F.lit(0.0)
    hits = F.coalesce("designation_hits", F.lit(0)) if designation is not None else F.lit(0)
    votes = F.lit(1.0) / (F.col("semantic_rank") + V.RRF_K)
    votes = F.when(F.col("lexical_rank").isNotNull(), F.lit(V.LEXICAL_WEIGHT) / (F.col("lexical_rank") + V.RRF_K)
                   + votes).otherwise(votes)
    score = votes + hits * V.DESIGNATION_WEIGHT + alias_score * V.ALIAS_WEIGHT
    scored = pool.join(corpus.select("doc", "status"), "doc").withColumn(
        "score", F.round(F.when(F.col("status") != "active", score * V.SUPERSEDED_PENALTY).otherwise(score), 12))
    ranked = topk(scored.withColumn("_a", alias_score > 0).withColumn("_h", hits.cast("bigint")),
                  ["query"], ["-score", "doc"], k)
    return ranked.select("query", "doc", "rank", "score", "lexical_rank", "semantic_rank", "similarity",
                         "bm25_score", F.col("_h").alias("designation_hits"), F.col("_a").alias("alias_hit"))


def rerank_fuse(hits: DataFrame, score: str, text: str, depth: int = V.RERANK_DEPTH, k: int = V.RERANK_K) -> DataFrame:
    """Fuse the first ``depth`` hits of each query with a reranker's order; the tail keeps its place.

    ``hits(query, doc, rank, status, <text>, <score>)``. A query that is not in Latin script, is
    blank, or has no reranker scores passes through unchanged.
    """
    head = hits.filter(F.col("rank") <= depth)
    usable = head.groupBy("query").agg(
        (F.count(score) == F.count(F.lit(1))).alias("_scored"),
        F.first(is_latin(text) & (F.trim(text) != "")).alias("_latin"))
    head = head.join(usable, "query")
    window = Window.partitionBy("query").orderBy(F.col(score).desc_nulls_last(), "rank")  # at most depth rows
    head = head.withColumn("rerank_rank", F.row_number().over(window))
    fused = F.lit(1.0) / (F.col("rank") + k) + F.lit(1.0) / (F.col("rerank_rank") + k)
    fused = F.when(F.col("status") != "active", fused * V.SUPERSEDED_PENALTY).otherwise(fused)
    head = head.withColumn("_ok", F.col("_scored") & F.col("_latin"))
    head = head.withColumn("reranked_score", F.when(F.col("_ok"), F.round(fused, 12)))
    head = head.withColumn("rerank_rank", F.when(F.col("_ok"), F.col("rerank_rank")))
    final = Window.partitionBy("query").orderBy(F.col("reranked_score").desc_nulls_last(), "rank")
    head = head.withColumn("final_rank", F.row_number().over(final).cast("bigint"))
    tail = hits.filter(F.col("rank") > depth).withColumn("final_rank", F.col("rank").cast("bigint"))
    return head.drop("_scored", "_latin", "_ok").unionByName(tail, allowMissingColumns=True)


def supersession_penalty(hits: DataFrame, penalty: float = 2.0, k: int = 10) -> DataFrame:
    """Demote superseded hits that have an active member of their family in the same result set.

    ``hits(query, doc, score, status, family)``, ties by doc. Scores are shifted to be positive
    and scaled to at most 1 first. Adds ``pre_rank``, ``final_rank``, ``final_score``,
    ``superseded_by`` and ``nearby_superseded`` (pushed out of the top k by a family leader that is
    itself in the top three). A result set is a ranked list, so its window is short.
    """
    results = Window.partitionBy("query")
    stats = hits.withColumn("_lo", F.min("score").over(results)).withColumn("_hi", F.max("score").over(results))
    shift = F.when(F.col("_lo") < 0, -F.col("_lo") + 0.01).otherwise(F.lit(0.0))
    top = F.col("_hi") + shift
    scaled = (F.col("score") + shift) * F.when(top > 1.0, F.lit(1.0) / top).otherwise(F.lit(1.0))
    base = stats.withColumn("_orig", F.round(scaled, 12)).drop("_lo", "_hi")
    can_lead = (F.col("status") == "active") & (F.col("family") != "")
    best = F.min(F.when(can_lead, F.struct((-F.col("_orig")).alias("s"), F.col("doc"))))
    joined = base.withColumn("_leader", best.over(Window.partitionBy("query", "family")))
    hit = (F.col("status") == "superseded") & F.col("_leader").isNotNull()
    floor = F.greatest(F.lit(0.0), -F.col("_leader.s") - 0.1)
    penalised = F.greatest(F.lit(0.0), F.least(F.col("_orig") - penalty, floor))
    out = joined.withColumn("superseded_by", F.when(hit, F.col("_leader.doc"))).withColumn(
        "_score", F.when(hit, penalised).otherwise(F.col("_orig"))).drop("_leader")
    before = Window.partitionBy("query").orderBy(F.desc("_orig"), "doc")
    after = Window.partitionBy("query").orderBy(F.desc("_score"), F.desc("_orig"), "doc")
    out = out.withColumn("pre_rank", F.row_number().over(before).cast("bigint"))
    out = out.withColumn("final_rank", F.row_number().over(after).cast("bigint"))
    heads = F.collect_list(F.when(F.col("final_rank") <= 3, F.col("doc"))).over(results)  # three ids
    out = out.withColumn("_head", F.array_contains(heads, F.col("superseded_by")))
    nearby = (F.col("pre_rank") <= k) & (F.col("final_rank") > k) & F.coalesce("_head", F.lit(False))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round("_score", 4)))
    return out.withColumn("nearby_superseded", nearby).withColumn("final_score", clamped).drop("_orig", "_score", "_head")


def score_shape(hits: DataFrame) -> DataFrame:
    """Per query: number of hits, top score, margin between the first two, population deviation."""
    return hits.groupBy("query").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"),
        F.max(F.when(F.col("rank") == 1, F.col("doc"))).alias("top_doc"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"),
        F.stddev_pop("score").alias("stdev"),
    ).withColumn("margin", F.col("top") - F.col("second"))


def orphan_gate(queries: DataFrame, hits: DataFrame, linked: DataFrame | None, min_margin: float = 0.10,
                min_stdev: float = 0.05, corroborate_below: float = 0.20, floor: float | None = None) -> DataFrame:
    """Decide per query whether its results are an orphan: (query, orphan, reason, margin, stdev, corroborated).

    ``linked(doc)`` lists records with at least one graph neighbour; without it nothing corroborates.
    """
    shape = queries.select("query").join(score_shape(hits), "query", "left")
    if linked is None:
        shape = shape.withColumn("_edge", F.lit(None).cast("boolean"))
        edge = F.lit(None).cast("boolean")
    else:
        marks = linked.select(F.col("doc").alias("top_doc"), F.lit(True).alias("_edge")).distinct()
        shape = shape.join(marks, "top_doc", "left")
        edge = F.coalesce("_edge", F.lit(False))
    none = F.col("n").isNull()
    low = (F.col("top") < floor) if floor is not None else F.lit(False)
    single = F.col("n") == 1
    asked = single | (F.col("margin") < corroborate_below)
    corroborated = F.when(~none & ~low & asked, edge)
    yes = F.coalesce(corroborated, F.lit(False))
    reason = (
        F.when(none, "no_candidates")
        .when(low, "below_absolute_floor")
        .when(single & ~yes, "single_candidate_no_corroboration")
        .when(single, F.lit(None))
        .when((F.col("margin") < min_margin) & ~yes, "insufficient_margin")
        .when((F.col("margin") >= min_margin) & (F.col("stdev") < min_stdev), "flat_score_distribution")
    )
    shown = F.when(~none & ~low & ~single, F.col("margin"))
    deviation = F.when(~none & (F.col("n") > 1), F.col("stdev"))
    return shape.select("query", reason.isNotNull().alias("orphan"), reason.alias("reason"),
                        F.round(shown, 6).alias("margin"), F.round(deviation, 6).alias("stdev"),
                        corroborated.alias("corroborated"))


def confidence_level(col, hi: float = 0.0, lo: float = -6.0) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNull(), "none").when(c >= hi, "strong").when(c <= lo, "none").otherwise("uncertain")


def display_score(hits: DataFrame, fused: str, similarity: str) -> DataFrame:
    """Scores in [0, 1] that keep the fused order, anchored at the top hit's similarity."""
    top = F.max(F.when(F.col("rank") == 1, F.least(F.greatest(F.col(similarity), F.lit(0.0)), F.lit(1.0))))
    results = Window.partitionBy("query")
    stats = (hits.withColumn("_lo", F.min(fused).over(results)).withColumn("_hi", F.max(fused).over(results))
             .withColumn("_top", top.over(results)))
    span = F.col("_hi") - F.col("_lo")
    shown = F.round(F.col("_top") * ((F.col(fused) - F.col("_lo")) / span * 0.65 + 0.35), 4)
    return stats.withColumn("display_score", F.when(span <= 0, F.lit(1.0)).otherwise(shown)).drop("_lo", "_hi", "_top")


def topk_filtered(hits: DataFrame, keep: Column, k: int, mode: str = "before") -> DataFrame:
    """Top k with a filter applied before ranking, or after reading the first 2k (may return fewer)."""
    if mode == "before":
        return topk(hits.filter(keep), ["query"], ["-score", "doc"], k)
    wide = topk(hits, ["query"], ["-score", "doc"], 2 * k, "_wide").filter(keep)
    return topk(wide, ["query"], ["-score", "doc"], k).drop("_wide")


def candidate_pool_size(n: int) -> int:
    return max(30, min(120, math.isqrt(n) * 3))
