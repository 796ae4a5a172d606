"""Exact vector search by blocks: no pair is emitted unless it can be a result."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specloom.operators.ranking import topk

DIGITS = 9  # similarities are compared after rounding, so equal vectors tie exactly


#: Cells of the product that a task holds at once (64 MB of doubles).
CELLS = 8_000_000


def usable(df: DataFrame, id_col: str) -> DataFrame:
    """(id, vec) without null vectors; a length other than the others' is an error, not a shifted matrix."""
    rows = df.select(id_col, "vec").filter(F.col("vec").isNotNull())
    first = rows.select(F.size("vec").alias("n")).first()
    if first is None:
        return rows
    wrong = F.raise_error(F.concat(F.lit(f"vector of another length than {first['n']}: "), F.size("vec").cast("string")))
    return rows.withColumn("vec", F.when(F.size("vec") == first["n"], F.col("vec")).otherwise(wrong))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist())


def _cut(n: int, rows: int) -> int:
    return max(1, math.ceil(n / rows))


def _tile(df: DataFrame, own: str, own_n: int, other: str, other_n: int, *keys: str) -> DataFrame:
    """Hash rows into ``own_n`` blocks and send each row to every block of the other side."""
    return df.withColumn(own, F.pmod(F.xxhash64(*keys), F.lit(own_n)).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))))


def dense_search(queries: DataFrame, docs: DataFrame, k: int, block_rows: int = 20_000,
                 floor: float | None = None, pooled: bool = False) -> DataFrame:
    """Top ``k`` documents per query by inner product, as (query, doc, similarity, rank).

    Both sides are hashed into even blocks; one task multiplies one query block with one document
    block, a slice of queries at a time, and returns at most ``k`` rows per query (ties: smaller id). Inputs
    are (query, vec) and (doc, vec); null vectors take no part, unequal lengths are an error. With ``pooled`` a document
    may have several vectors, in any blocks, and the best one counts.
    """
    queries, docs = usable(queries, "query"), usable(docs, "doc")
    e, d = _cut(queries.count(), block_rows), _cut(docs.count(), block_rows)
    left = _tile(queries, "_qb", e, "_db", d, "query")
    right = _tile(docs, "_db", d, "_qb", e, *(("doc", "vec") if pooled else ("doc",)))
    schema = T.StructType([queries.schema["query"], docs.schema["doc"], T.StructField("similarity", T.DoubleType())])

    def block(q: pa.Table, x: pa.Table) -> pa.Table:
        found_q, found_d, found_s = [], [], []
        if q.num_rows and x.num_rows:
            x = x.sort_by("doc")  # columns in the order of ids: a stable sort then breaks ties
            vectors, others = _matrix(q["vec"]), _matrix(x["vec"]).T
            step = max(1, CELLS // x.num_rows)
            if pooled:
                owners = _ids(x["doc"])
                starts = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
                x = x.take(starts)
            for first in range(0, q.num_rows, step):
                sims = np.round(vectors[first:first + step] @ others, DIGITS) + 0.0
                if pooled:
                    sims = np.maximum.reduceat(sims, starts, axis=1)
                rows, cols = np.nonzero(_candidates(sims, k, floor))
                order = np.lexsort((cols, -sims[rows, cols], rows))
                rows, cols = rows[order], cols[order]
                place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                rows, cols = rows[place < k], cols[place < k]
                found_q.append(rows + first)
                found_d.append(cols)
                found_s.append(sims[rows, cols])
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        at, of = join(found_q, np.int64), join(found_d, np.int64)
        return pa.table({"query": q["query"].take(at), "doc": x["doc"].take(of), "similarity": join(found_s, np.float64)}).cast(_arrow(schema))

    found = left.groupBy("_qb", "_db").cogroup(right.groupBy("_qb", "_db")).applyInArrow(block, schema)
    if pooled:
        found = found.groupBy("query", "doc").agg(F.max("similarity").alias("similarity"))
    return topk(found, ["query"], ["-similarity", "doc"], k)


def _candidates(sims: np.ndarray, k: int, floor: float | None) -> np.ndarray:
    """What reaches each row's k-th best value, ties included, and the floor."""
    least = np.partition(sims, -k, axis=1)[:, -k] if sims.shape[1] > k else np.full(len(sims), -np.inf)
    return sims >= np.maximum(least, -np.inf if floor is None else floor)[:, None]


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields])


def dot(a: str, b: str):
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.round(F.aggregate(products, F.lit(0.0), lambda s, x: s + x), DIGITS) + F.lit(0.0)


def pair_similarity(pairs: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Similarity of given (query, doc) pairs."""
    q, d = queries.select("query", F.col("vec").alias("_q")), docs.select("doc", F.col("vec").alias("_d"))
    return pairs.join(q, "query").join(d, "doc").withColumn("similarity", dot("_q", "_d")).drop("_q", "_d")


def similarity_rank(pairs: DataFrame, queries: DataFrame, docs: DataFrame, block_rows: int = 20_000,
                    pair_rows: int = 500_000) -> DataFrame:
    """Exact full-corpus rank of given (query, doc, similarity) rows, by counting better documents
    block by block.

    Pairs are hashed by (query, doc) into blocks, so a query with very many pairs is spread too.
    A pair row carries no vector: each block gets every query's vector once, next to its pairs.
    """
    p, d = _cut(pairs.count(), pair_rows), _cut(docs.count(), block_rows)
    probes = _tile(pairs.select("query", "doc", "similarity"), "_pb", p, "_db", d, "query", "doc")
    asked = queries.select("query", "vec").join(pairs.select("query").distinct(), "query", "left_semi")
    every = F.sequence(F.lit(0), F.lit(p - 1))
    asked = _tile(asked, "_x", 1, "_db", d, "query").drop("_x").withColumn("_pb", F.explode(every))
    left = probes.unionByName(asked, allowMissingColumns=True)
    right = _tile(docs.select("doc", "vec"), "_db", d, "_pb", p, "doc")
    schema = T.StructType([pairs.schema["query"], pairs.schema["doc"], T.StructField("better", T.LongType())])

    def block(q: pa.Table, x: pa.Table) -> pa.Table:
        is_query = pc.is_valid(q["vec"])
        asked_rows, pair_table = q.filter(is_query), q.filter(pc.invert(is_query))
        better = np.zeros(pair_table.num_rows, dtype=np.int64)
        if pair_table.num_rows and x.num_rows:
            docs_m, doc_ids = _matrix(x["vec"]), _ids(x["doc"])
            vectors = dict(zip(asked_rows["query"].to_pylist(), _matrix(asked_rows["vec"])))
            qid, pid = _ids(pair_table["query"]), _ids(pair_table["doc"])
            sim = np.array(pair_table["similarity"].to_pylist())
            by_query = np.argsort(qid, kind="stable")
            names, starts = np.unique(qid[by_query], return_index=True)
            for name, at in zip(names.tolist(), np.split(by_query, starts[1:])):
                s = np.round(docs_m @ vectors[name], DIGITS) + 0.0
                order = np.lexsort((doc_ids, -s))
                falling, ids = -s[order], doc_ids[order]
                lo = np.searchsorted(falling, -sim[at], "left")
                hi = np.searchsorted(falling, -sim[at], "right")
                for i, a, b in zip(at, lo, hi):
                    better[i] = a + np.searchsorted(ids[a:b], pid[i])
        return pa.table({"query": pair_table["query"], "doc": pair_table["doc"], "better": better}, schema=_arrow(schema))

    counted = left.groupBy("_pb", "_db").cogroup(right.groupBy("_pb", "_db")).applyInArrow(block, schema)
    ranks = counted.groupBy("query", "doc").agg((F.sum("better") + 1).alias("semantic_rank"))
    return pairs.join(ranks, ["query", "doc"])


def pooled_search(queries: DataFrame, docs: DataFrame, chunks: DataFrame, k: int, damp: float) -> DataFrame:
    """Top ``k`` documents by the best of their own similarity and all their chunks' damped ones.

    ``docs(doc, vec)``, ``chunks(doc, vec)`` where doc owns the chunk; one without an own vector takes part by its chunks.
    Every chunk is read: a damped chunk is a shorter vector of its owner, and an owner's vectors are spread over blocks.
    """
    scaled = chunks.select("doc", F.transform("vec", lambda x: x.cast("double") * damp).alias("vec"))
    own = docs.select("doc", F.col("vec").cast("array<double>").alias("vec"))
    return dense_search(queries, own.unionByName(scaled), k, pooled=True)


def pool_chunks(doc_scores: DataFrame, chunk_scores: DataFrame, damp: float) -> DataFrame:
    """Best of a document's own similarity and its damped chunk similarities, whichever there are: (query, doc, similarity)."""
    damped = chunk_scores.select("query", "doc", (F.col("similarity") * damp).alias("_chunk"))
    best = damped.groupBy("query", "doc").agg(F.max("_chunk").alias("_chunk"))
    return doc_scores.join(best, ["query", "doc"], "full").withColumn(
        "similarity", F.greatest("similarity", "_chunk")).drop("_chunk")
