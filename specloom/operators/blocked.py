"""Exact BM25 by blocks of documents: no (query, document) pair leaves a task unless it can be a result.

Postings are dealt into blocks of at most about ``block_docs`` documents. One task lays a block out by term, adds up a query's postings
in an array over the block's documents, and returns at most ``k`` of them. Documents of like length share a block, because the
highest contribution of a term in a block (its block maximum) falls with length; the sum of a query's block maxima bounds every score in the block.

Search takes two passes: a sixteenth of the blocks gives each query a threshold, its k-th best score so far. In the other
blocks a query whose bound is below its threshold is skipped unscored, and only scores that reach the threshold are returned. (With
up to ``ONE_PASS`` blocks a second job costs more than it spares, and all blocks are scored at once.)

Ranks of given pairs in the whole corpus are counted the same way: every block tells how many of its documents stand before.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specloom.functions import vocab as V
from specloom.operators.ranking import topk
from specloom.session import cut_lineage

DIGITS = 9  # scores are compared after rounding, so equal documents tie exactly
BLOCK_DOCS, QUERY_ROWS, PASSES, ONE_PASS = 2048, 2000, 16, 64
KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, KINDS[f.dataType.simpleString()]) for f in schema.fields])


class Block:
    """Postings of a block's documents by term, and the block maximum and minimum of each term."""

    def __init__(self, x: pa.Table):
        names = np.array(x["doc"].to_pylist())
        self.ids, places = np.unique(names, return_inverse=True)
        live = pc.is_valid(x["term"]).to_numpy(zero_copy_only=False).astype(bool)
        coded = x["term"].filter(pa.array(live)).combine_chunks().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        part = x["part"].to_numpy()[live].astype(np.float64)
        order = np.argsort(codes, kind="stable")
        self.places, self.part = places[live][order], part[order]
        self.numbers = {t: i for i, t in enumerate(coded.dictionary.to_pylist())}
        self.starts = np.searchsorted(codes[order], np.arange(len(self.numbers) + 1))
        self.top = np.maximum.reduceat(self.part, self.starts[:-1]) if len(self.part) else np.zeros(0)
        self.low = np.minimum.reduceat(self.part, self.starts[:-1]) if len(self.part) else np.zeros(0)

    def terms(self, names: list, weights: list) -> list[tuple[int, float]]:
        return [(self.numbers[t], w) for t, w in zip(names, weights) if t in self.numbers]

    def bound(self, terms: list[tuple[int, float]]) -> float:
        """No document of the block scores more. (A document may lack any of the terms.)"""
        return sum(max(0.0, w * self.top[i], w * self.low[i]) for i, w in terms) + 10.0 ** -DIGITS

    def scores(self, terms: list[tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
        """(score of each document, whether it has any of the terms)."""
        total, seen = np.zeros(len(self.ids)), np.zeros(len(self.ids), bool)
        for i, w in terms:
            at = self.places[self.starts[i]:self.starts[i + 1]]
            total[at] += w * self.part[self.starts[i]:self.starts[i + 1]]
            seen[at] = True
        return np.round(total, DIGITS) + 0.0, seen


def first_places(score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores; equal ones in their given order."""
    at = np.arange(len(score))
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.argsort(-score[at], kind="stable")[:k]]


def by_query(q: pa.Table) -> dict:
    """query: (terms, weights)."""
    out: dict = {}
    for query, term, w in zip(q["query"].to_pylist(), q["term"].to_pylist(), q["w"].to_pylist()):
        names, weights = out.setdefault(query, ([], []))
        if term is not None:
            names.append(term)
            weights.append(w)
    return out


def contributions(index, wanted: DataFrame) -> DataFrame:
    """(term, doc, dl, part) of the postings that some query wants: the score of one occurrence in a query per unit of idf."""
    k1, b = V.BM25_K1, V.BM25_B
    norm = (F.col("dl") / index.totals.select("avgdl").scalar()) * b + (1 - b)
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + norm * k1)
    held = index.postings.join(wanted.select("term").distinct(), "term", "left_semi")
    return held.select("term", "doc", "dl", part.alias("part"))


def weights(index, asked: DataFrame) -> DataFrame:
    """(query, term, w): how much a query's term weighs; ``asked(query, term, qtf)``."""
    return cut_lineage(asked.join(index.terms.select("term", "idf"), "term").select("query", "term", (F.col("qtf") * F.col("idf")).alias("w")))


def length_blocks(index, block_docs: int) -> tuple[dict[int, tuple[int, int]], int]:
    """(length class: (first block, number of blocks), number of all blocks). A class is half an octave of length. Its documents are
    counted as the sum of tf / dl over its postings, which is 1 for each document."""
    half = F.floor(F.log2(F.col("dl")) * 2).cast("int")
    counts = index.postings.groupBy(half.alias("c")).agg(F.sum(F.col("tf") / F.col("dl")).alias("n")).orderBy("c").collect()
    out, first = {}, 0
    for r in counts:  # some 80 classes at most
        n = max(1, math.ceil(r["n"] / block_docs))
        out[r["c"]] = (first, n)
        first += n
    return out, max(1, first)


def dealt_by_length(parts: DataFrame, classes: dict[int, tuple[int, int]]) -> DataFrame:
    half = F.floor(F.log2(F.col("dl")) * 2).cast("int")
    table = lambda j: F.create_map(*[F.lit(v) for c, x in classes.items() for v in (c, x[j])])[half]
    return parts.withColumn("_db", (table(0) + F.pmod(F.xxhash64("doc"), table(1))).cast("int"))


def _range(n: int):
    return F.sequence(F.lit(0), F.lit(int(n) - 1))


def search(index, asked: DataFrame, k: int, positive_only: bool = True, block_docs: int = BLOCK_DOCS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Top ``k`` documents per query as (query, doc, score, rank), ties by doc, of those that share a term with it."""
    wanted = weights(index, asked)
    classes, d = length_blocks(index, block_docs)
    e = max(1, math.ceil(wanted.select("query").distinct().count() / query_rows))
    if not classes:
        classes = {0: (0, 1)}
    parts = dealt_by_length(contributions(index, wanted), classes).select("term", "doc", "part", "_db").withColumn("_qb", F.explode(_range(e)))
    schema = T.StructType([wanted.schema["query"], index.postings.schema["doc"], T.StructField("score", T.DoubleType())])

    def block(q: pa.Table, x: pa.Table) -> pa.Table:
        queries, docs, scores = [], [], []
        if q.num_rows and x.num_rows:
            held = Block(x)
            floors = dict(zip(q["query"].to_pylist(), q["least"].to_pylist()))
            for query, (names, w) in by_query(q).items():
                terms, least = held.terms(names, w), floors[query]
                if not terms or least is not None and held.bound(terms) < least:
                    continue
                score, seen = held.scores(terms)
                keep = seen & (score > 0) if positive_only else seen
                if least is not None:
                    keep &= score >= least
                at = np.flatnonzero(keep)
                at = at[first_places(score[at], k)]
                queries += [query] * len(at)
                docs.append(held.ids[at])
                scores.append(score[at])
        ids = np.concatenate(docs).tolist() if docs else []
        return pa.table({"query": queries, "doc": ids, "score": np.concatenate(scores) if scores else []}, schema=arrow_schema(schema))

    def found(chosen: list[int], floors: DataFrame | None) -> DataFrame:
        own = wanted.withColumn("_qb", F.pmod(F.xxhash64("query"), F.lit(e)).cast("int"))
        own = own.withColumn("least", F.lit(None).cast("double")) if floors is None else own.join(floors, "query", "left")
        first, step = chosen
        own = own.withColumn("_db", F.explode(F.sequence(F.lit(first), F.lit(d - 1), F.lit(step))) if step else F.explode(F.filter(_range(d), lambda i: i % PASSES != 0)))
        some = F.col("_db") % PASSES == 0 if step == PASSES else F.col("_db") % PASSES != 0 if not step else F.lit(True)
        pairs = own.groupBy("_qb", "_db").cogroup(parts.filter(some).groupBy("_qb", "_db"))
        return topk(pairs.applyInArrow(block, schema), ["query"], ["-score", "doc"], k)

    if d <= ONE_PASS:
        return found([0, 1], None)
    head = cut_lineage(found([0, PASSES], None))
    floors = head.filter(F.col("rank") == k).select("query", F.col("score").alias("least"))
    rest = found([0, 0], floors)
    return topk(head.unionByName(rest).drop("rank"), ["query"], ["-score", "doc"], k)


def _by_hash(index, wanted: DataFrame, corpus: DataFrame, block_docs: int) -> tuple[DataFrame, int]:
    """(term, doc, part, _db): wanted postings and one row without a term for each document, in blocks by hash; their number."""
    d = max(1, math.ceil(corpus.count() / block_docs))
    every = corpus.select(F.lit(None).cast("string").alias("term"), "doc", F.lit(0.0).alias("part"))
    rows = contributions(index, wanted).select("term", "doc", "part").unionByName(every)
    return rows.withColumn("_db", F.pmod(F.xxhash64("doc"), F.lit(d)).cast("int")), d


def first_ranks(index, asked: DataFrame, corpus: DataFrame, depth: int, block_docs: int = BLOCK_DOCS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query, doc, score, rank): the first ``depth`` documents of the whole corpus by falling score, then doc, for each query with a
    positive score. Documents that share no term have score 0."""
    wanted = weights(index, asked)
    rows, d = _by_hash(index, wanted, corpus, block_docs)
    e = max(1, math.ceil(wanted.select("query").distinct().count() / query_rows))
    right = rows.withColumn("_qb", F.explode(_range(e)))
    left = wanted.withColumn("_qb", F.pmod(F.xxhash64("query"), F.lit(e)).cast("int")).withColumn("_db", F.explode(_range(d)))
    schema = T.StructType([wanted.schema["query"], corpus.schema["doc"], T.StructField("score", T.DoubleType())])

    def block(q: pa.Table, x: pa.Table) -> pa.Table:
        queries, docs, scores = [], [], []
        if q.num_rows and x.num_rows:
            held = Block(x)
            for query, (names, w) in by_query(q).items():
                score, _ = held.scores(held.terms(names, w))
                at = first_places(score, depth)
                queries += [query] * len(at)
                docs.append(held.ids[at])
                scores.append(score[at])
        return pa.table({"query": queries, "doc": np.concatenate(docs).tolist() if docs else [], "score": np.concatenate(scores) if scores else []}, schema=arrow_schema(schema))

    ranked = topk(left.groupBy("_qb", "_db").cogroup(right.groupBy("_qb", "_db")).applyInArrow(block, schema), ["query"], ["-score", "doc"], depth)
    ranked = cut_lineage(ranked)
    live = ranked.filter((F.col("rank") == 1) & (F.col("score") > 0)).select("query")
    return ranked.join(live, "query", "left_semi")


def counted_ranks(index, asked: DataFrame, corpus: DataFrame, pairs: DataFrame, block_docs: int = BLOCK_DOCS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``pairs(query, doc, ...)`` with ``bm25_score`` and ``lexical_rank``, the place in the whole corpus by falling score, then doc; NULL for a
    query without a positive score.

    The first job scores each pair in its document's block; the second counts in every block the documents that stand
    before it. Neither emits more rows than pairs x blocks, and a block's counts are summed before the shuffle.
    """
    wanted = weights(index, asked)
    rows, d = _by_hash(index, wanted, corpus, block_docs)
    rows = cut_lineage(rows)
    e = max(1, math.ceil(pairs.select("query").distinct().count() / query_rows))
    block_of = F.pmod(F.xxhash64("query"), F.lit(e)).cast("int")
    right = rows.withColumn("_qb", F.explode(_range(e)))
    terms = wanted.select("query", "term", "w").join(pairs.select("query").distinct(), "query", "left_semi")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("term", "string"), ("w", "double"))]
    kinds = (wanted.schema["query"], corpus.schema["doc"])
    given = T.StructType([*kinds, T.StructField("score", T.DoubleType())])

    def asked_of(probes: DataFrame) -> DataFrame:
        """A probe row for each pair, and the terms of the queries."""
        lists = terms.select("query", F.lit(None).cast(kinds[1].dataType).alias("doc"), F.lit(None).cast("double").alias("score"), "term", "w")
        lists = lists.withColumn("_qb", block_of).withColumn("_db", F.explode(_range(d)))
        return probes.select("query", "doc", "score", *none, "_qb", "_db").unionByName(lists)

    def split(q: pa.Table) -> tuple[dict, dict]:
        """(query: (terms, weights), query: its probes as (doc, score))."""
        probe = pc.is_valid(q["doc"])
        probes: dict = {}
        some = q.filter(probe)
        for query, doc, score in zip(some["query"].to_pylist(), some["doc"].to_pylist(), some["score"].to_pylist()):
            probes.setdefault(query, []).append((doc, score))
        return by_query(q.filter(pc.invert(probe))), probes

    def score_block(q: pa.Table, x: pa.Table) -> pa.Table:
        queries, docs, out = [], [], []
        if q.num_rows and x.num_rows:
            held, (lists, probes) = Block(x), split(q)
            for query, some in probes.items():
                score, _ = held.scores(held.terms(*lists.get(query, ([], []))))
                names = np.array([s[0] for s in some])
                at = np.minimum(np.searchsorted(held.ids, names), len(held.ids) - 1)
                at = at[held.ids[at] == names]  # a document outside the corpus has no rank
                queries += [query] * len(at)
                docs += held.ids[at].tolist()
                out += score[at].tolist()
        return pa.table({"query": queries, "doc": docs, "score": out}, schema=arrow_schema(given))

    counts = T.StructType([*kinds, *[T.StructField(n, T.LongType()) for n in ("before", "positive")]])

    def count_block(q: pa.Table, x: pa.Table) -> pa.Table:
        queries, docs, before, positive = [], [], [], []
        if q.num_rows and x.num_rows:
            held, (lists, probes) = Block(x), split(q)
            for query, some in probes.items():
                score, _ = held.scores(held.terms(*lists.get(query, ([], []))))
                order = np.argsort(-score, kind="stable")  # ids ascend, so ties stand by id
                falling, ids = -score[order], held.ids[order]
                names, own = np.array([s[0] for s in some]), np.array([s[1] for s in some])
                lo, hi = np.searchsorted(falling, -own, "left"), np.searchsorted(falling, -own, "right")
                queries += [query] * len(some)
                docs += names.tolist()
                before += [int(a + np.searchsorted(ids[a:b], n)) for a, b, n in zip(lo, hi, names)]
                positive += [int((score > 0).sum())] * len(some)
        return pa.table({"query": queries, "doc": docs, "before": before, "positive": positive}, schema=arrow_schema(counts))

    probes = pairs.select("query", "doc", F.lit(None).cast("double").alias("score")).withColumn("_qb", block_of)
    home = asked_of(probes.withColumn("_db", F.pmod(F.xxhash64("doc"), F.lit(d)).cast("int")))
    scored = cut_lineage(home.groupBy("_qb", "_db").cogroup(right.groupBy("_qb", "_db")).applyInArrow(score_block, given))
    spread = asked_of(scored.withColumn("_qb", block_of).withColumn("_db", F.explode(_range(d))))
    places = spread.groupBy("_qb", "_db").cogroup(right.groupBy("_qb", "_db")).applyInArrow(count_block, counts)
    ranks = places.groupBy("query", "doc").agg((F.sum("before") + 1).alias("_rank"), F.sum("positive").alias("_positive"))
    ranks = ranks.select("query", "doc", F.when(F.col("_positive") > 0, F.col("_rank")).alias("lexical_rank"))
    return pairs.join(scored.withColumnRenamed("score", "bm25_score"), ["query", "doc"]).join(ranks, ["query", "doc"])
