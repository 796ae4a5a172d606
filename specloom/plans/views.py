"""Views of the given tables in the shapes the operators take, as Spark frames and as SQL text.

Each SQL constant is one or more common table expressions; ``cte`` joins them into a statement.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specloom.functions.rows import token_slices
from specloom.operators.ranking import spread, tasks_for
from specloom.plans.registry import Tables


def cte(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


def stored(sql: str, *names: str) -> str:
    """The statement with these common tables computed once instead of in each use."""
    return reduce(lambda s, n: re.sub(rf"(?<![\w.]){n} AS \(SELECT", f"{n} AS MATERIALIZED (SELECT", s, count=1), names, sql)


# ---- documents and queries -------------------------------------------------------------------

def bench_queries(t: Tables) -> DataFrame:
    """(query, text, kind): benchmark passages; kind is short or long by length."""
    return t.benchmark.select(F.col("item_id").alias("query"), "text",
                              F.when(F.length("text") < 180, "short").otherwise("long").alias("kind"))


BENCH = """bq AS (SELECT item_id AS query, text, CASE WHEN length(text) < 180 THEN 'short' ELSE 'long' END AS kind
 FROM benchmark)"""


def doc_corpus(t: Tables) -> DataFrame:
    """(doc, text, source, lang, status, family)."""
    return spread(t.documents, "doc_id").select(
        F.col("doc_id").alias("doc"), "text", "source", "lang",
        F.when(F.col("doc_id") % 7 == 0, "superseded").otherwise("active").alias("status"),
        F.concat(F.lit("F"), F.col("doc_id") % 5).alias("family"))


DOCS = """dc AS (SELECT doc_id AS doc, text, source, lang,
 CASE WHEN doc_id % 7 = 0 THEN 'superseded' ELSE 'active' END AS status,
 concat('F', doc_id % 5) AS family FROM documents)"""


def qrels(t: Tables) -> DataFrame:
    return containing(t.benchmark.select(F.col("item_id").alias("query"), "text"),
                      spread(t.documents, "doc_id").select(F.col("doc_id").alias("doc"), "text"))


def word_runs(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """(id, size, n, run): a hash of each run of ``n`` words of ``texts(id, text, size)``, for all ``lengths``. A word is hashed once, and a run's hash is a
    sum over its words."""
    schema = T.StructType([texts.schema.fields[0], T.StructField("size", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("run", T.LongType())])
    factors = [pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(max(lengths, default=0))]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = pc.split_pattern_regex(batch.column(1), r"[ \t\n\x0B\f\r]+")
            for part, sizes in token_slices([pa.RecordBatch.from_arrays([batch.column(0), split, batch.column(2)], names=["id", "words", "size"])]):
                coded = part.column(1).flatten().dictionary_encode()
                names = [int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little") for w in coded.dictionary.to_pylist()]
                each = np.array(names, np.uint64)[coded.indices.to_numpy()]
                left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(each))  # words from here to the end of the row
                row = np.repeat(np.arange(len(sizes)), sizes)
                for n in lengths:
                    if n <= len(each):
                        total = sum(each[j:len(each) - n + 1 + j] * np.uint64(factors[j]) for j in range(n))
                        at = np.flatnonzero(left[:len(total)] >= n)
                        own = pa.array(row[at])
                        yield pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(2).take(own), pa.array(np.full(len(at), n, np.int32)), pa.array(total[at].view(np.int64))], names=schema.names)

    return texts.mapInArrow(hashed, schema)


def containing(passages: DataFrame, docs: DataFrame, longest: int = 8) -> DataFrame:
    """(query, doc): documents whose text contains the passage anywhere. A blank passage is in none.

    Containment needs a text test, so candidates come from an equi-join; ``contains`` confirms them. A passage's first and
    last words may go on in the document, the ones between them are whole words of it: the key is the run of the first
    of these, at most ``longest``. A passage of one or two words has none; its longer word is looked for inside the document's words.
    """
    ws = passages.filter(F.col("text").rlike(r"\S")).withColumn("ws", F.split("text", r"\s+"))
    words = docs.select("doc", F.split("text", r"\s+").alias("ws"))

    inner = ws.filter(F.size("ws") > 2).withColumn("n", F.least(F.size("ws") - 2, F.lit(longest)))
    lengths = sorted(r["n"] for r in inner.select("n").distinct().collect())  # at most ``longest`` numbers
    runs = word_runs(inner.select("query", F.array_join(F.slice("ws", F.lit(2), F.col("n")), " ").alias("text"), F.col("n").alias("size")), lengths).filter("n = size").select("query", "n", "run")
    by_run = word_runs(docs.select("doc", "text", F.lit(0).alias("size")), lengths).select("doc", "n", "run").join(runs, ["n", "run"]).select("query", "doc")

    longer = F.array_max(F.transform("ws", lambda w: F.struct(F.length(w).alias("n"), w.alias("piece"))))
    short = ws.filter(F.size("ws") <= 2).withColumn("l", longer).select("query", "l.n", "l.piece")
    sizes = short.agg(F.collect_set("n").alias("l")).select("l").scalar()  # word lengths
    one = words.withColumn("n", F.explode(sizes)).select("doc", "n", F.explode(F.array_distinct("ws")).alias("w")).filter(F.length("w") >= F.col("n"))
    pieces = F.transform(F.sequence(F.lit(1), F.length("w") - F.col("n") + 1), lambda i: F.col("w").substr(i, F.col("n")))
    by_piece = one.select("doc", F.explode(pieces).alias("piece")).join(short, "piece").select("query", "doc")

    pairs = by_run.unionByName(by_piece).distinct()
    checked = pairs.join(passages, "query").join(docs.select("doc", F.col("text").alias("doc_text")), "doc")
    return checked.filter(F.col("doc_text").contains(F.col("text"))).select("query", "doc").distinct()


QRELS = """qrels AS (SELECT DISTINCT b.item_id AS query, d.doc_id AS doc FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE regexp_matches(b.text, '\\S'))"""


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vec"), "label")


# ---- BM25 in SQL -----------------------------------------------------------------------------

def bm25_cte(docs: str, queries: str, pattern: str = "[a-z0-9]+", stop: list[str] | None = None) -> str:
    """score(query, doc, score) for SQL relations docs(doc, text) and queries(query, text)."""
    keep = "" if not stop else " WHERE term NOT IN (" + ",".join(f"'{w}'" for w in stop) + ")"
    return f"""dtok AS (SELECT * FROM (SELECT doc, unnest(regexp_extract_all(lower(text), '{pattern}')) AS term FROM {docs}){keep}),
dlen AS (SELECT d.doc, coalesce(c.n, 0) AS dl FROM {docs} d LEFT JOIN (SELECT doc, count(*) AS n FROM dtok GROUP BY doc) c USING (doc)),
post AS (SELECT doc, term, count(*) AS tf FROM dtok GROUP BY doc, term),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dlen),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
idf0 AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM dfs, tot),
idfs AS (SELECT term, df, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf0) ELSE idf END AS idf FROM idf0),
qtok AS (SELECT query, term, count(*) AS qtf FROM
 (SELECT query, unnest(regexp_extract_all(lower(text), '{pattern}')) AS term FROM {queries}) GROUP BY query, term),
score AS (SELECT query, p.doc, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
 FROM qtok JOIN post p USING (term) JOIN idfs USING (term) JOIN dlen l ON l.doc = p.doc, tot GROUP BY query, p.doc)"""


def encode_cte(name: str, source: str, key: str, dim: int = 64) -> str:
    """name(key, bucket, w): the hashing encoder's non-zero entries."""
    return f"""{name} AS (SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS w FROM (
 SELECT {key}, (('0x' || substr(md5(term), 1, 4))::INTEGER % {dim}) AS bucket, count(*)::DOUBLE AS n FROM
 (SELECT {key}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM {source}) GROUP BY {key}, bucket))"""


# ---- standards, edges, drafts, logs ----------------------------------------------------------

def standards(t: Tables) -> DataFrame:
    """(id, base, edition_year, number, title, category, department, price) from part."""
    return t.part.select(
        F.concat(F.lit("S"), F.col("p_partkey")).alias("id"),
        (F.col("p_partkey") % 100 + 100).alias("base"),
        (F.col("p_size") + 1960).alias("edition_year"),
        F.concat(F.lit("IS "), F.col("p_partkey") % 100 + 100, F.lit(":"), F.col("p_size") + 1960).alias("number"),
        F.concat("p_name", F.lit(" "), "p_type").alias("title"),
        F.lower("p_type").alias("category"), F.col("p_brand").alias("department"),
        F.col("p_retailprice").alias("price"), F.col("p_partkey").alias("key"))


STD = """std AS (SELECT concat('S', p_partkey) AS id, 100 + p_partkey % 100 AS base, 1960 + p_size AS edition_year,
 concat('IS ', 100 + p_partkey % 100, ':', 1960 + p_size) AS number, concat(p_name, ' ', p_type) AS title,
 lower(p_type) AS category, p_brand AS department, p_retailprice AS price, p_partkey AS key FROM part)"""

# status by edition: the unique newest of a family supersedes the others
STATUS = """fam0 AS (SELECT base, count(*) AS n, max(edition_year) AS top_year FROM std GROUP BY base),
fam AS (SELECT f.base, f.n, f.top_year, count(*) AS top_n, min(s.id) AS top_id FROM fam0 f JOIN std s
 ON s.base = f.base AND s.edition_year = f.top_year GROUP BY f.base, f.n, f.top_year),
sts AS (SELECT s.*, CASE WHEN n > 1 AND top_n = 1 AND edition_year < top_year THEN 'superseded' ELSE 'active' END AS status,
 CASE WHEN n > 1 AND top_n = 1 AND edition_year < top_year THEN top_id END AS superseded_by FROM std s JOIN fam USING (base))"""


def edges(t: Tables) -> DataFrame:
    """(source_id, target_id, type): parts on consecutive lines of one order. The number of tasks grows with the order lines."""
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    n = tasks_for(t.spark, t.lineitem.count())
    a = li.withColumn("next", F.col("l_linenumber") + 1).repartition(n, "l_orderkey", "next").alias("a")
    b = li.withColumn("next", F.col("l_linenumber")).repartition(n, "l_orderkey", "next").alias("b")
    pair = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey"))
                  & (F.col("a.next") == F.col("b.next"))
                  & (F.col("a.l_partkey") != F.col("b.l_partkey")))
    code = (F.col("a.l_linenumber") + F.col("b.l_partkey")) % 7
    kinds = ["NORMATIVE_REFERENCE", "TEST_METHOD_FOR", "RELATED_PRODUCT", "SUPERSEDED_BY", "AMENDED_BY", "OVERLAPS_SCOPE_WITH"]
    kind = F.lit("UNMAPPED_TYPE")
    for i, name in enumerate(kinds, start=1):
        kind = F.when(code == i, name).otherwise(kind)
    made = pair.select(F.concat(F.lit("S"), F.col("a.l_partkey")).alias("source_id"),
                       F.concat(F.lit("S"), F.col("b.l_partkey")).alias("target_id"), kind.alias("type"))
    return made.repartition(n, "source_id", "target_id", "type").distinct()


EDGE = """edge AS (SELECT DISTINCT concat('S', a.l_partkey) AS source_id, concat('S', b.l_partkey) AS target_id,
 CASE (a.l_linenumber + b.l_partkey) % 7 WHEN 1 THEN 'NORMATIVE_REFERENCE' WHEN 2 THEN 'TEST_METHOD_FOR'
 WHEN 3 THEN 'RELATED_PRODUCT' WHEN 4 THEN 'SUPERSEDED_BY' WHEN 5 THEN 'AMENDED_BY'
 WHEN 6 THEN 'OVERLAPS_SCOPE_WITH' ELSE 'UNMAPPED_TYPE' END AS type
 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
 WHERE a.l_partkey <> b.l_partkey)"""


def drafts(t: Tables) -> DataFrame:
    """(doc, text): one four-line purchase draft per order line, citing up to three numbers."""
    li = spread(t.lineitem, "l_orderkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_size")
    j = li.join(p, "l_partkey")
    doc = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                      F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    second = F.concat(F.lit("Testing to IS "), F.col("l_suppkey") % 100 + 100,
                      F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" (Part "), F.col("l_linenumber") % 3 + 1, F.lit(")")))
                      .otherwise(F.lit("")), F.lit("."))
    last = (F.when(F.col("l_returnflag") == "R", F.lit("Goods shall bear the Standard Mark."))
            .when(F.col("l_returnflag") == "A", F.concat(F.lit("Ref IS 99"), F.col("l_linenumber"), F.lit(":2001")))
            .otherwise(F.lit("Delivery in 30 days")))
    text = F.concat(F.lit("Supply of "), "p_name", F.lit(" as per IS "), F.col("l_partkey") % 100 + 100, F.lit(":"),
                    F.col("p_size") + 1960, F.lit(".\n"), second, F.lit("\n- "), "p_name", F.lit(" "), F.lower("p_type"),
                    F.lit("\n"), last)
    return j.select(doc.alias("doc"), text.alias("text"))


DRAFT = """draft AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT) AS doc,
 concat('Supply of ', p_name, ' as per IS ', 100 + l_partkey % 100, ':', 1960 + p_size, '.', chr(10),
 'Testing to IS ', 100 + l_suppkey % 100, CASE WHEN l_linenumber % 2 = 0 THEN concat(' (Part ', 1 + l_linenumber % 3, ')') ELSE '' END, '.', chr(10),
 '- ', p_name, ' ', lower(p_type), chr(10), CASE l_returnflag WHEN 'R' THEN 'Goods shall bear the Standard Mark.'
 WHEN 'A' THEN concat('Ref IS 99', l_linenumber, ':2001') ELSE 'Delivery in 30 days' END) AS text
 FROM lineitem JOIN part ON l_partkey = p_partkey)"""

_CITE = r"(?i)\b(?:IS\s*/\s*(?:IEC|ISO)|IS|BIS)\s*:?\s*\d{2,5}(?:\s*[-–]\s*\d{1,4})?(?:\s*\(\s*(?:Part|Pt\.?|P)\s*[-\s]?\d+(?:\s*/\s*Sec(?:tion)?\.?\s*\d+)?\s*\))?(?:\s*[:\-–]\s*(?:19|20)\d{2})?"
CITE = f"""cite0 AS (SELECT doc, regexp_extract_all(text, '{_CITE}') AS m, string_split_regex(text, '{_CITE}') AS g FROM draft),
cite1 AS (SELECT doc, m, g, unnest(range(1, len(m) + 1)) AS i FROM cite0),
cite2 AS (SELECT doc, i - 1 AS pos, m[i] AS raw, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS st FROM cite1),
cite AS (SELECT doc, pos, raw, regexp_extract(raw, '(\\d{{2,5}})', 1) AS base, nullif(regexp_extract(raw, '(?i)(?:Part|Pt\\.?|P)\\s*[-\\s]?(\\d+)', 1), '') AS part,
 CAST(nullif(regexp_extract(raw, '[:\\-–]\\s*((?:19|20)\\d{{2}})$', 1), '') AS INTEGER) AS year, st::BIGINT AS "start", (st + length(raw))::BIGINT AS "end" FROM cite2)"""


def scanned(t: Tables) -> DataFrame:
    """(key, item_id, text): a scanned-standard text per part, with scope, clause 2, a body and an annex."""
    k = F.col("p_partkey")

    def n(shift: int):
        return ((k + shift) % 100 + 100).cast("string")

    y = (F.col("p_size") + 1960).cast("string")
    text = F.concat(
        F.lit("Indian Standard\n"), F.upper(F.concat("p_name", F.lit(" "), "p_type")), F.lit(" FOR SITES ( First Revision )\nICS 91.100."),
        k % 30, F.lit("\nSectional Committee, CED "), k % 50 + 1, F.lit("\n1 SCOPE\nThis standard covers "), "p_name",
        F.lit(" of brand "), "p_brand", F.lit(" used in general works.\n2 REFERENCES\nIS "), n(7), F.lit(" : "), y, F.lit(", IS "), n(13),
        F.lit(" (Part 2) and IS "), n(0), F.lit(".\n3 TERMINOLOGY\n"), F.repeat(F.concat("p_name", F.lit(" shall be sound. ")), 10),
        F.lit("\nANNEX A LIST OF REFERRED INDIAN STANDARDS IS No. "), n(3), F.lit(" : 1981 Title sampling 3025 (Part 1) : 1987 (Part 2) : 2002 "),
        n(5), F.lit(" : 2003 (Part 9) : 1999 "), n(0), F.lit(" : 1990"))
    return t.part.select(k.alias("key"), F.concat(F.lit("gov.in.is."), n(0), F.lit("."), y).alias("item_id"), text.alias("text"))


SCAN = """scan AS (SELECT p_partkey AS key, 100 + p_partkey % 100 AS n, 100 + (p_partkey + 7) % 100 AS n7, 100 + (p_partkey + 13) % 100 AS n13,
 100 + (p_partkey + 3) % 100 AS n3, 100 + (p_partkey + 5) % 100 AS n5, 1960 + p_size AS y, p_name, p_type, p_brand FROM part)"""
