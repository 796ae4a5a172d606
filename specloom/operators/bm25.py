"""BM25 over any number of queries: postings, statistics, search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specloom.functions import vocab as V
from specloom.functions.rows import repeats, token_slices
from specloom.functions.text import tokens
from specloom.operators import blocked
from specloom.operators.ranking import salted_join, topk
from specloom.session import cut_lineage


@dataclass
class Bm25Index:
    """``postings(term, doc, tf, dl)``, ``terms(term, df, idf)`` and the one-row ``totals(n, avgdl)``."""

    postings: DataFrame
    terms: DataFrame
    totals: DataFrame
    variant: str

    def write(self, path: str, buckets: int = 64) -> None:
        """Store the three tables; postings are clustered by term so a reader prunes row groups."""
        (self.postings.repartition(buckets, "term").sortWithinPartitions("term", "doc")
         .write.mode("overwrite").parquet(f"{path}/postings"))
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.totals.write.mode("overwrite").parquet(f"{path}/totals")

    @staticmethod
    def read(spark: SparkSession, path: str, variant: str) -> Bm25Index:
        return Bm25Index(*[spark.read.parquet(f"{path}/{n}") for n in ("postings", "terms", "totals")], variant)


def row_counts(rows: DataFrame) -> DataFrame:
    """(term, doc, dl, tf) of ``rows(doc, tokens)``: how often each row holds each of its tokens. A row's tokens are counted where it is, so
    that nothing is sorted, spilled or shuffled."""
    schema = T.StructType([T.StructField("term", T.StringType()), rows.schema["doc"], T.StructField("dl", T.LongType()), T.StructField("tf", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sizes in token_slices(batches):
            if sizes.sum():
                owner = np.repeat(np.arange(len(sizes)), sizes)
                held = pa.table({"row": owner, "term": part.column(1).flatten()}).group_by(["row", "term"]).aggregate([([], "count_all")])
                row, term, tf = (held[c].combine_chunks() for c in ("row", "term", "count_all"))
                yield pa.RecordBatch.from_arrays([term, part.column(0).take(row), pa.array(sizes).take(row), tf], names=schema.names)

    return rows.mapInArrow(count, schema)


def build_bm25(docs: DataFrame, key: str, text: str, variant: str = "alnum") -> Bm25Index:
    """Index a corpus: one pass over the text, written once and read by every later step.

    All tokens of a document are in one row and counted there; only if rows share a key do their
    postings pass through a shuffle. Totals come from document counts and stored postings.
    """
    postings = row_counts(docs.select(F.col(key).alias("doc"), tokens(text, variant).alias("tokens")))
    if repeats(docs, key):
        postings = postings.groupBy("term", "doc", "dl").agg(F.sum("tf").alias("tf"))
    postings = cut_lineage(postings)
    n = docs.select(key).agg(F.count(F.lit(1)).alias("n"))
    length = postings.agg(F.sum("tf").alias("length")).select("length").scalar()
    totals = n.select("n", (F.coalesce(length, F.lit(0)) / F.greatest(F.col("n"), F.lit(1))).alias("avgdl"))
    return Bm25Index(postings, cut_lineage(term_stats(postings, totals)), totals, variant)


def term_stats(postings: DataFrame, totals: DataFrame) -> DataFrame:
    """(term, df, idf) of an index's postings."""
    return weigh_terms(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), totals)


def weigh_terms(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(term, df, idf) of ``counts(term, df)``; a negative idf becomes epsilon times the mean idf of the vocabulary."""
    n = totals.select("n").scalar()
    raw = counts.withColumn("idf", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("idf")).scalar()
    return raw.withColumn("idf", F.when(F.col("idf") < 0, mean * V.BM25_EPSILON).otherwise(F.col("idf")))


def query_terms(queries: DataFrame, key: str, text: str, variant: str) -> DataFrame:
    return (
        queries.select(F.col(key).alias("query"), F.explode(tokens(text, variant)).alias("term"))
        .groupBy("query", "term").agg(F.count(F.lit(1)).alias("qtf"))
    )


def bm25_scores(queries: DataFrame, index: Bm25Index, key: str, text: str, salts: int = 8) -> DataFrame:
    """(query, doc, score) for every pair that shares a term. Frequent terms are salted by document;
    contributions are summed map-side before the (query, doc) shuffle."""
    wanted = query_terms(queries, key, text, index.variant).join(index.terms.select("term", "idf"), "term")
    k1, b = V.BM25_K1, V.BM25_B
    norm = (F.col("dl") / index.totals.select("avgdl").scalar()) * b + (1 - b)
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm * k1)
    matched = salted_join(index.postings, wanted, ["term"], "doc", salts)
    return matched.groupBy("query", "doc").agg(F.round(F.sum(part), 9).alias("score"))


def bm25_search(queries: DataFrame, index: Bm25Index, k: int, key: str, text: str,
                positive_only: bool = True, **blocks) -> DataFrame:
    """Top ``k`` documents per query as (query, doc, score, rank); ties go to the smaller doc.

    Exact, but no pair of a query and a document is listed unless it can be a result (see ``blocked``).
    """
    return blocked.search(index, query_terms(queries, key, text, index.variant), k, positive_only, **blocks)


def full_text_search(queries: DataFrame, index: Bm25Index, k: int, key: str, text: str) -> DataFrame:
    """Documents that hold every query word, ranked by summed term frequency.

    A result holds the query's rarest word, so only documents with that word meet the query's other words; a query with a word
    that no document holds has none.
    """
    wanted = cut_lineage(query_terms(queries, key, text, index.variant))  # written, so that Spark knows its size before it plans the joins
    known = wanted.join(index.terms.select("term", "df"), "term", "left")
    rarest = known.groupBy("query").agg(F.count(F.lit(1)).alias("_needed"), F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("_r"))
    rarest = cut_lineage(rarest.filter(F.col("_r.df") > 0).select("query", "_needed", F.col("_r.term").alias("term")))
    start = salted_join(index.postings.select("term", "doc"), rarest, ["term"], "doc").select("query", "doc", "_needed").distinct()
    asked = start.join(wanted.select("query", "term"), "query")
    hits = asked.join(index.postings.select("term", "doc", "tf"), ["term", "doc"]).groupBy("query", "doc", "_needed").agg(
        F.count(F.lit(1)).alias("_have"), F.sum("tf").alias("score"))
    full = hits.filter(F.col("_have") == F.col("_needed"))
    return topk(full.select("query", "doc", "score"), ["query"], ["-score", "doc"], k)
