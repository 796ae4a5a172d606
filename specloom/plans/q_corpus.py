"""Corpus-building queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from specloom.functions import extract as E
from specloom.functions import numbers as N
from specloom.functions import text as X
from specloom.operators import corpus as C
from specloom.plans import views as W
from specloom.plans.registry import Tables, query


@query("document_fields", W.cte(W.SCAN) + """SELECT key, concat_ws('_', 'IS', n, y) AS id, concat('IS ', n) AS number, y AS edition_year,
 concat(array_to_string(list_transform(string_split(concat(p_name, ' ', lower(p_type)), ' '), lambda w: upper(w[1:1]) || w[2:]), ' '), ' for Sites') AS title,
 concat('This standard covers ', p_name, ' of brand ', p_brand, ' used in general works.') AS scope, concat('CED ', key % 50 + 1) AS committee, concat('91.100.', key % 30) AS ics, 'high' AS data_confidence FROM scan""")
def _(t: Tables):
    # parts share item ids, so every row gets its own key as the id's section
    keyed = W.scanned(t).withColumn("item_id", F.concat_ws(
        ".", F.lit("gov.in.is"), N.item_id_fields("item_id")["number"], F.lit("1"), F.col("key").cast("string"), N.item_id_fields("item_id")["year"]))
    r = E.extract_records(keyed)
    key = F.split("item_id", r"\.")[5].cast("bigint")
    return r.select(key.alias("key"), F.concat_ws("_", F.lit("IS"), F.split("id", "_")[1], F.element_at(F.split("id", "_"), -1)).alias("id"),
                    F.regexp_replace("number", r" \(Part 1\)$", "").alias("number"), "edition_year", "title", "scope", "committee", "ics", "data_confidence")


REFS = """refs AS (SELECT key, 'annex' AS src, 0 AS pos, n3::VARCHAR AS number, NULL AS part, 1981 AS year FROM scan UNION ALL SELECT key, 'annex', 1, '3025', '1', 1987 FROM scan
 UNION ALL SELECT key, 'annex', 2, '3025', '2', 2002 FROM scan UNION ALL SELECT key, 'annex', 3, n5::VARCHAR, NULL, 2003 FROM scan
 UNION ALL SELECT key, 'clause', 0, n7::VARCHAR, NULL, y FROM scan UNION ALL SELECT key, 'clause', 1, n13::VARCHAR, '2', NULL FROM scan)"""


@query("referred_standards", W.cte(W.SCAN, REFS) + "SELECT key, pos, number, part, year FROM refs WHERE src = 'annex'")
def _(t: Tables):
    d = W.scanned(t)
    a = E.annex_references("text", N.item_id_fields("item_id")["number"])
    return d.select("key", F.posexplode(a).alias("pos", "r")).select("key", "pos", "r.number", "r.part", "r.year")


@query("clause_references", W.cte(W.SCAN, REFS) + "SELECT key, pos, number, part, year FROM refs WHERE src = 'clause'")
def _(t: Tables):
    d = W.scanned(t)
    a = E.clause_references("text", N.item_id_fields("item_id")["number"])
    return d.select("key", F.posexplode(a).alias("pos", "r")).select("key", "pos", "r.number", "r.part", "r.year")


@query("references_annex_over_clause", W.cte(W.SCAN, REFS) + "SELECT key, number, part, year FROM refs")
def _(t: Tables):
    d = W.scanned(t)
    own = N.item_id_fields("item_id")["number"]
    both = d.select("key", E.annex_references("text", own).alias("a"), E.clause_references("text", own).alias("c"))
    return both.select("key", F.explode(E.all_references("a", "c")).alias("r")).select("key", "r.number", "r.part", "r.year")


@query("retrieval_chunks", W.cte(W.SCAN) + """SELECT key, 0 AS chunk_no, 'scope' AS kind, concat('This standard covers ', p_name, ' of brand ', p_brand, ' used in general works.') AS text FROM scan
 UNION ALL SELECT key, 1, 'normative_references', concat('Refers to: IS ', n3, ', IS 3025 (Part 1), IS 3025 (Part 2), IS ', n5) FROM scan
 UNION ALL SELECT key, 2, 'body', concat('3 TERMINOLOGY ', repeat(concat(p_name, ' shall be sound. '), 10), 'ANNEX A LIST OF REFERRED INDIAN STANDARDS IS No. ', n3, ' :') FROM scan
 UNION ALL SELECT key, 3, 'body', concat('1981 Title sampling 3025 (Part 1) : 1987 (Part 2) : 2002 ', n5, ' : 2003 (Part 9) : 1999 ', n, ' : 1990') FROM scan WHERE length(concat('1981 Title sampling 3025 (Part 1) : 1987 (Part 2) : 2002 ', n5, ' : 2003 (Part 9) : 1999 ', n, ' : 1990')) >= 120""")
def _(t: Tables):
    d = W.scanned(t)
    own = N.item_id_fields("item_id")["number"]
    parts = d.select("key", E.scope("text").alias("s"), E.annex_references("text", own).alias("a"), E.body_passages("text").alias("p"))
    return E.build_chunks(parts.select("key", E.chunk_array("s", "a", "p").alias("chunks")), "key")


@query("extracted_record_count", W.cte(W.SCAN) + "SELECT concat_ws('_', 'IS', n, y) AS id, count(*) AS n, sum(4)::BIGINT AS refs FROM scan GROUP BY ALL")
def _(t: Tables):
    r = E.extract_records(W.scanned(t))
    return r.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("referred_standards")).alias("refs"))


RAW = """raw AS (SELECT p_partkey AS key, CASE p_partkey % 6 WHEN 0 THEN NULL ELSE concat('IS ', 100 + p_partkey % 400, ':', 1960 + p_size) END AS number,
 CASE p_partkey % 7 WHEN 0 THEN 'Glossary of terms' WHEN 1 THEN '' ELSE concat(p_name, ' tests') END AS title,
 p_partkey % 5 <> 0 AS has_text, p_partkey % 11 <> 0 AS has_scope, p_name, p_type FROM part)"""


@query("archive_ingest_outcomes", W.cte(RAW) + """, e AS (SELECT number, min(key) AS f FROM raw WHERE number IS NOT NULL AND key % 7 > 1 GROUP BY number)
 SELECT key, CASE WHEN raw.number IS NULL THEN 'bad_id' WHEN key % 7 <= 1 THEN 'bad_title' WHEN key > f THEN 'duplicate' WHEN NOT has_text THEN 'no_text' WHEN NOT has_scope THEN 'no_scope'
 WHEN regexp_matches(p_name, 'bolt') OR regexp_matches(p_name, 'gear') THEN NULL ELSE 'no_sector' END AS reason,
 CASE WHEN raw.number IS NOT NULL AND key % 7 > 1 AND key <= f AND has_text AND has_scope AND regexp_matches(p_name, 'bolt|gear') THEN CASE WHEN regexp_matches(p_name, 'bolt') THEN 'structural_steel' ELSE 'machinery_equipment' END END AS category
 FROM raw LEFT JOIN e ON e.number = raw.number""")
def _(t: Tables):
    k = F.col("p_partkey")
    item = F.when(k % 6 == 0, F.concat(F.lit("junk."), k)).otherwise(F.concat(F.lit("gov.in.is."), k % 400 + 100, F.lit("."), F.col("p_size") + 1960))
    title = F.when(k % 7 == 0, "IS 12: Glossary of terms").when(k % 7 == 1, "").otherwise(F.concat(F.lit("IS 77: "), "p_name", F.lit(" tests")))
    body = F.concat(F.lit("IS 9\n1. SCOPE\nThis standard lays down the mater-ial needs of "), "p_name", F.lit(" ~ for all sites and works.\n2. REFERENCES\nother"))
    text = F.when(k % 5 == 0, "").when(k % 11 == 0, "nothing here").otherwise(body)
    raw = t.part.select(k.alias("ordinal"), item.alias("item_id"), title.alias("title"), text.alias("text"))
    out = C.ingest_documents(raw)
    kept = F.col("skip_reason").isNull()
    return out.select(F.col("ordinal").alias("key"), F.col("skip_reason").alias("reason"), F.when(kept, F.col("category")).alias("category"))


# ---- sources to consolidate: every number arrives from several sources -------------------------
SRC = """src AS (SELECT p_partkey AS ordinal, concat('src', p_partkey % 3) AS source, concat('IS ', 100 + p_partkey % 300, ' (Part ', 1 + p_partkey % 2, '):', 1990 + p_partkey % 5) AS number,
 p_name AS title, repeat(p_name, 1 + p_size % 5) AS scope, lower(p_type) AS category, [p_brand, p_name, lower(p_type)] AS keywords FROM part)"""


def sources(t: Tables):
    k = F.col("p_partkey")
    loose = F.concat(F.lit(" IS  "), k % 300 + 100, F.when(k % 3 == 0, " ( part ").otherwise(" (Part "), k % 2 + 1, F.lit(" ) : "), k % 5 + 1990)
    return t.part.select(k.alias("ordinal"), F.concat(F.lit("src"), k % 3).alias("source"), loose.alias("number"), F.col("p_name").alias("title"),
                         F.repeat("p_name", F.col("p_size") % 5 + 1).alias("scope"), F.lit("").alias("description"), F.col("p_type").alias("category"),
                         F.lit("Active").alias("status"), F.array("p_brand", "p_name", F.lower("p_type")).alias("keywords"))


def category_map(t: Tables):
    names = t.part.select(F.lower("p_type").alias("value")).distinct().filter(F.col("value") != "promo")
    return names.select("value", F.col("value").alias("canonical"), F.upper(F.substring("value", 1, 4)).alias("prefix"))


CONS = (SRC, """win AS (SELECT number, max_by(ordinal, length(scope) * 1000000000 - ordinal) AS w, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM src GROUP BY number),
kw AS (SELECT number, string_agg(word, ',' ORDER BY o, p) AS keywords FROM (SELECT number, word, min(o) AS o, min_by(p, o * 10 + p) AS p FROM (SELECT s.number, s.ordinal AS o, unnest(s.keywords) AS word, unnest(range(3)) AS p FROM src s JOIN win USING (number) WHERE s.ordinal >= w) GROUP BY number, word) GROUP BY number),
con AS (SELECT number, title, scope, category, sources, kw.keywords FROM win JOIN src s USING (number) JOIN kw USING (number) WHERE s.ordinal = w)""")


@query("consolidated_corpus", W.cte(*CONS) + """SELECT number, title, scope, category, upper(regexp_extract(number, '^([^:]*)', 1)) AS family, 'active' AS status, sources, keywords,
 concat('IS-', upper(category[1:4]), '-', lpad(row_number() OVER (PARTITION BY upper(category[1:4]) ORDER BY number)::VARCHAR, 3, '0')) AS id FROM con WHERE category <> 'promo'""")
def _(t: Tables):
    good, _ = C.consolidate(sources(t), category_map(t))
    return good.select("number", "title", "scope", "category", "family", "status", F.array_join("sources", ",").alias("sources"),
                       F.array_join("keywords", ",").alias("keywords"), "id")


@query("unmapped_categories", W.cte(*CONS) + "SELECT number, category FROM con WHERE category = 'promo'")
def _(t: Tables):
    _, rejects = C.consolidate(sources(t), category_map(t))
    return rejects.select("number", F.lower("category").alias("category"))


@query("expanded_corpus", """SELECT provenance, count(*) AS n, count(DISTINCT number) AS numbers FROM (SELECT 'curated' AS provenance, concat('IS ', p_partkey % 300, ':1990') AS number FROM part WHERE p_partkey % 2 = 0
 UNION ALL SELECT 'added', number FROM (SELECT concat('IS ', p_partkey % 500, ':1990') AS number FROM part WHERE p_partkey % 2 = 1) WHERE number NOT IN (SELECT concat('IS ', p_partkey % 300, ':1990') FROM part WHERE p_partkey % 2 = 0)) GROUP BY ALL""")
def _(t: Tables):
    base = t.part.filter("p_partkey % 2 = 0").select(F.concat(F.lit("IS "), F.col("p_partkey") % 300, F.lit(" : 1990")).alias("number"), F.col("p_name").alias("title"))
    add = t.part.filter("p_partkey % 2 = 1").select(F.concat(F.lit("IS  "), F.col("p_partkey") % 500, F.lit(":1990")).alias("number"), F.col("p_brand").alias("department"))
    return C.expand_corpus(base, add, "added").groupBy("provenance").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("number").alias("numbers"))


@query("full_corpus_outcomes", """WITH i AS (SELECT doc_id AS ordinal, concat('IS ', doc_id % 600) AS number, length(trim(text)) >= 60 AS longer, text, source FROM documents),
 s AS (SELECT *, trim(regexp_replace(string_split_regex(string_split_regex(text, '(?i)\\s+\\d+\\s+(?:REFERENCES?|TERMINOLOGY|DEFINITIONS?|NORMATIVE|GENERAL|REQUIREMENTS?)\\b')[1], '\\s+[*f†]\\s*[A-Z]')[1], '^[.\\s]*\\d+(\\.\\d+)*\\s*', '')) AS sc FROM i),
 u AS (SELECT *, length(sc) >= 60 AND len(regexp_extract_all(sc, '[^\\x20-\\x7E]')) / greatest(length(sc), 1) < 0.05 AS usable, ordinal % 600 < 50 AS held, source <> 'src0' AS sector FROM s),
 k AS (SELECT number, min(ordinal) FILTER (usable AND sector AND NOT held) AS taken FROM u GROUP BY number)
 SELECT ordinal, CASE WHEN held OR ordinal > taken THEN 'duplicate' WHEN NOT usable THEN 'bad_scope' WHEN NOT sector THEN 'other_sector' ELSE 'kept' END AS outcome FROM u JOIN k USING (number)""")
def _(t: Tables):
    ing = t.documents.select(F.col("doc_id").alias("ordinal"), F.concat(F.lit("IS "), F.col("doc_id") % 600).alias("number"),
                             F.lit("t").alias("title"), F.col("text").alias("scope"), F.col("source").alias("category"))
    cur = t.documents.filter(F.col("doc_id") % 600 < 50).select(F.concat(F.lit(" IS  "), F.col("doc_id") % 600).alias("number"))
    sectors = t.documents.filter("source <> 'src0'").select(F.col("source").alias("category")).distinct()
    return C.full_corpus_outcomes(cur, ing, sectors).select("ordinal", "outcome")


OVER = """f AS (SELECT p_partkey AS ordinal, 100 + p_partkey % 150 AS base, (1 + p_partkey % 2)::VARCHAR AS part, 1990 + p_size % 10 AS year, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS scope,
 CASE WHEN p_partkey % 4 = 0 THEN 100 + (p_partkey + 1) % 150 END AS sb, (1 + (p_partkey + 1) % 2)::VARCHAR AS sp, 1990 + (p_size + 1) % 10 AS sy FROM part),
f1 AS (SELECT base, part, year, min_by(title, ordinal) AS title, min_by(scope, ordinal) AS scope, min_by(sb, CASE WHEN sb IS NOT NULL THEN ordinal END) AS sb,
 min_by(sp, CASE WHEN sb IS NOT NULL THEN ordinal END) AS sp, min_by(sy, CASE WHEN sb IS NOT NULL THEN ordinal END) AS sy FROM f GROUP BY base, part, year),
c AS (SELECT concat('C', s_suppkey) AS cid, 100 + s_suppkey AS base, '1' AS part, 1992 AS year, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS title, CASE WHEN s_suppkey % 3 = 0 THEN 'curated scope' ELSE '' END AS scope FROM supplier),
m AS (SELECT coalesce(f1.base, c.base) AS base, coalesce(f1.part, c.part) AS part, coalesce(f1.year, c.year) AS year, coalesce(cid, concat_ws('_', 'IS', f1.base, f1.part, f1.year)) AS id,
 coalesce(nullif(c.title, ''), f1.title) AS title, coalesce(nullif(f1.scope, ''), nullif(c.scope, ''), '') AS scope, sb, sp, sy,
 CASE WHEN f1.base IS NULL THEN 'curated_only' WHEN cid IS NOT NULL THEN 'overlaid' ELSE 'archive' END AS origin FROM f1 FULL JOIN c ON f1.base = c.base AND f1.part = c.part AND f1.year = c.year)"""


@query("overlay_merged_corpus", W.cte(OVER) + "SELECT m.id, m.title, m.scope, m.origin, x.id AS superseded_by FROM m LEFT JOIN m x ON x.base = m.sb AND x.part = m.sp AND x.year = m.sy")
def _(t: Tables):
    k = F.col("p_partkey")

    def num(shift):
        return F.concat(F.lit("IS "), (k + shift) % 150 + 100, F.lit(" (Part "), (k + shift) % 2 + 1, F.lit("):"), (F.col("p_size") + shift) % 10 + 1990)

    full = t.part.select(k.alias("ordinal"), num(0).alias("number"), F.concat(F.lit("1991: "), "p_name").alias("title"),
                         F.when(k % 3 == 0, "").otherwise(F.col("p_type")).alias("scope"), F.lit("active").alias("status"),
                         F.when(k % 4 == 0, num(1)).alias("superseded_by_number"))
    s = F.col("s_suppkey")
    cur = t.supplier.select(F.concat(F.lit("C"), s).alias("id"), F.concat(F.lit("IS "), s + 100, F.lit(" (Part 1)")).alias("number"),
                            F.lit(1992).alias("edition_year"), F.when(s % 2 == 0, F.col("s_name")).otherwise("").alias("title"),
                            F.when(s % 3 == 0, "curated scope").otherwise("").alias("scope"), F.lit("active").alias("status"),
                            F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("superseded_by"))
    return C.overlay_merge(full, cur).select("id", "title", "scope", "origin", "superseded_by")


def std_with_state(t: Tables):
    s = W.standards(t)
    return s.withColumn("family", N.family_key("number")).withColumn(
        "status", F.when(F.col("key") % 17 == 0, "withdrawn").otherwise("active")).withColumn(
        "superseded_by", F.when(F.col("key") % 19 == 0, F.lit("S1"))).withColumn(
        "supersession_source", F.when(F.col("key") % 23 == 0, "curated"))


@query("derived_supersession", W.cte(W.STD, W.STATUS) + """, d AS (SELECT s.id, s.edition_year, n, top_year, top_n, top_id, key, CASE WHEN n < 2 THEN 'single' WHEN top_n > 1 THEN 'ambiguous' WHEN edition_year = top_year THEN 'newest'
 WHEN key % 17 = 0 OR key % 19 = 0 OR key % 23 = 0 THEN 'left_alone' ELSE 'marked' END AS outcome FROM std s JOIN fam USING (base))
 SELECT id, outcome, CASE WHEN outcome = 'marked' THEN 'superseded' WHEN key % 17 = 0 THEN 'withdrawn' ELSE 'active' END AS status, CASE WHEN outcome = 'marked' THEN top_id WHEN key % 19 = 0 THEN 'S1' END AS superseded_by,
 CASE WHEN outcome = 'marked' THEN 'derived_from_edition_year' WHEN key % 23 = 0 THEN 'curated' END AS supersession_source FROM d""")
def _(t: Tables):
    return C.derive_supersession(std_with_state(t)).select("id", "outcome", "status", "superseded_by", "supersession_source")


@query("supersedes_links", W.cte(W.STD, W.STATUS) + "SELECT top_id AS id, s.id AS supersedes FROM std s JOIN fam USING (base) WHERE n > 1 AND top_n = 1 AND edition_year < top_year")
def _(t: Tables):
    return C.supersedes_links(C.derive_supersession(std_with_state(t)))


def review_rows(t: Tables):
    k, a = F.col("c_custkey"), F.col("c_nationkey")
    number = F.concat(F.lit("IS "), k % 110 + 95, F.when(k % 4 == 0, "").otherwise(F.concat(F.lit(" : "), a + 1985)))
    nxt = F.when(k % 3 == 0, "--").when(k % 3 == 1, F.concat(F.lit("IS "), k % 50 + 100, F.lit(" : "), F.lit(2000) + a % 10)).otherwise(F.concat(F.lit("IS "), k % 110 + 95))
    return t.customer.select(k.alias("ordinal"), number.alias("number"), F.col("c_mktsegment").alias("category"), nxt.alias("superseded_by"))


REVIEW = (W.STD, W.STATUS, """rv AS (SELECT c_custkey AS ordinal, 95 + c_custkey % 110 AS base, CASE WHEN c_custkey % 4 > 0 THEN 1985 + c_nationkey END AS year, c_mktsegment AS category,
 CASE c_custkey % 3 WHEN 1 THEN 100 + c_custkey % 50 WHEN 2 THEN 95 + c_custkey % 110 END AS sb, CASE WHEN c_custkey % 3 = 1 THEN 2000 + c_nationkey % 10 END AS sy FROM customer),
top AS (SELECT base, n, top_id FROM fam), ed AS (SELECT base, edition_year, min(id) AS pick FROM std GROUP BY base, edition_year),
rs AS (SELECT rv.*, top.n, top.top_id, CASE WHEN sy IS NOT NULL THEN e.pick ELSE t2.top_id END AS successor FROM rv LEFT JOIN top ON top.base = rv.base
 LEFT JOIN ed e ON e.base = sb AND e.edition_year = sy LEFT JOIN top t2 ON t2.base = sb),
rt AS (SELECT rs.*, s.id AS target FROM rs LEFT JOIN std s ON s.base = rs.base AND s.edition_year = rs.year WHERE year IS NOT NULL UNION ALL SELECT rs.*, CASE WHEN n = 1 THEN top_id END FROM rs WHERE year IS NULL),
ro AS (SELECT *, CASE WHEN n IS NULL THEN 'unmatched' WHEN target IS NULL THEN 'ambiguous' WHEN successor IS NULL AND target = top_id THEN 'refused' ELSE 'applied' END AS outcome FROM rt)""")


@query("review_row_outcomes", W.cte(*REVIEW) + """SELECT ordinal, target, outcome, CASE WHEN outcome = 'applied' THEN successor END AS successor, CASE WHEN outcome = 'applied' THEN CASE WHEN successor IS NULL THEN 'withdrawn' ELSE 'superseded' END END AS status,
 coalesce(outcome = 'applied' AND successor IS NOT NULL AND sb <> base, false) AS cross_number FROM ro""")
def _(t: Tables):
    out = C.review_outcomes(W.standards(t), review_rows(t))
    return out.select("ordinal", "target", "outcome", "successor", "status", F.coalesce("cross_number", F.lit(False)).alias("cross_number"))


@query("review_applied_corpus", W.cte(*REVIEW) + """, l AS (SELECT target, max_by(CASE WHEN successor IS NULL THEN 'withdrawn' ELSE 'superseded' END, ordinal) AS st, max_by(category, ordinal) AS cat, max_by(successor, CASE WHEN successor IS NOT NULL THEN ordinal END) AS nx FROM ro WHERE outcome = 'applied' GROUP BY target)
 SELECT s.id, coalesce(st, 'active') AS status, nx AS superseded_by, cat AS bis_review_category, CASE WHEN st IS NOT NULL THEN 'bis_standards_review' END AS supersession_source FROM std s LEFT JOIN l ON l.target = s.id""")
def _(t: Tables):
    null = F.lit(None).cast("string")
    s = W.standards(t).withColumn("status", F.lit("active")).withColumn("superseded_by", null).withColumn("supersession_source", null)
    return C.apply_review(s, review_rows(t)).select("id", "status", "superseded_by", "bis_review_category", "supersession_source")


@query("merged_records", """WITH ex AS (SELECT p_partkey AS id, p_name AS title, p_type AS scope, p_brand AS aliases, 'low' AS dc FROM part WHERE p_partkey % 3 > 0),
 ing AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE upper(p_name) END AS title, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE concat('scope ', p_type) END AS scope FROM part WHERE p_partkey % 2 = 0)
 SELECT coalesce(ex.id, ing.id) AS id, CASE WHEN ex.id IS NULL THEN ing.title ELSE coalesce(nullif(ing.title, ''), ex.title) END AS title, CASE WHEN ex.id IS NULL THEN ing.scope ELSE coalesce(nullif(ing.scope, ''), ex.scope) END AS scope,
 CASE WHEN ex.id IS NULL THEN '' ELSE aliases END AS aliases, CASE WHEN ex.id IS NULL THEN NULL WHEN coalesce(ing.scope, '') <> '' THEN 'high' ELSE dc END AS data_confidence,
 CASE WHEN ex.id IS NULL THEN 'added' WHEN ing.id IS NOT NULL THEN 'updated' ELSE 'untouched' END AS change FROM ex FULL JOIN ing ON ex.id = ing.id""")
def _(t: Tables):
    p = t.part
    ex = p.filter("p_partkey % 3 > 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("scope"),
                                              F.col("p_brand").alias("aliases"), F.lit("low").alias("data_confidence"))
    ing = p.filter("p_partkey % 2 = 0").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.upper("p_name")).alias("title"),
        F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("scope "), "p_type")).alias("scope"))
    return C.merge_records(ex, ing, ["title", "scope"], {"aliases": F.lit("")})


@query("snapshot_changes", """SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'added' WHEN doc_id % 5 = 1 THEN 'removed' ELSE 'changed' END AS change FROM documents WHERE doc_id % 5 IN (0, 1) OR (doc_id % 5 = 2)""")
def _(t: Tables):
    d = t.documents
    cur = C.snapshot(d.filter("doc_id % 5 <> 1"), "doc_id", ["text", "lang"])
    old = d.filter("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 2, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    return C.snapshot_diff(cur, C.snapshot(old, "doc_id", ["text", "lang"]))


@query("rows_to_embed", "SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def _(t: Tables):
    seen = t.documents.filter("doc_id % 2 = 0").select(F.sha2(F.concat("text", F.lit("\x00"), F.lit("m1")), 256).alias("cache_key"))
    return C.needs_embedding(t.documents, "text", "m1", seen.distinct()).select("doc_id")


@query("validation_problems", W.cte(W.EDGE) + """, s AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 50 = 0 THEN 'bad id ' || p_partkey ELSE concat('S', p_partkey - CASE WHEN p_partkey % 70 = 0 AND p_partkey > 0 THEN 1 ELSE 0 END) END AS id,
 concat('IS ', p_partkey // 2 * 2) AS number, CASE WHEN p_partkey % 40 = 0 THEN ' ' ELSE p_name END AS title, p_type AS scope, CASE p_partkey % 30 WHEN 0 THEN 'draft' WHEN 1 THEN 'superseded' ELSE 'active' END AS status,
 CASE WHEN p_partkey % 60 = 0 THEN 'x' ELSE '2001-02-03' END AS la, p_partkey % 80 = 0 AS nokw, CASE WHEN p_partkey % 30 = 1 THEN concat('IS ', p_partkey + 1) END AS sn, concat('F', p_partkey % 600) AS family FROM part)
 SELECT 'empty' AS rule, id AS key, 'title' AS detail FROM s WHERE trim(title) = '' UNION ALL SELECT 'id_format', id, id FROM s WHERE contains(id, ' ') UNION ALL SELECT 'status', id, status FROM s WHERE status = 'draft'
 UNION ALL SELECT 'date', id, la FROM s WHERE la = 'x' UNION ALL SELECT 'keywords', id, NULL FROM s WHERE nokw UNION ALL SELECT 'duplicate_id', id, count(*)::VARCHAR FROM s GROUP BY id HAVING count(*) > 1
 UNION ALL SELECT 'duplicate_number', number, count(*)::VARCHAR FROM s GROUP BY number HAVING count(*) > 1
 UNION ALL SELECT 'dangling_source_id', source_id, type FROM edge WHERE source_id NOT IN (SELECT id FROM s) UNION ALL SELECT 'dangling_target_id', target_id, type FROM edge WHERE target_id NOT IN (SELECT id FROM s)
 UNION ALL SELECT 'successor_missing', id, sn FROM s WHERE sn IS NOT NULL AND sn NOT IN (SELECT number FROM s)
 UNION ALL SELECT 'family_without_active', family, c::VARCHAR FROM (SELECT family, count(*) FILTER (status = 'active') AS a, count(*) FILTER (status = 'superseded' AND (sn IS NULL OR sn NOT IN (SELECT number FROM s))) AS c FROM s GROUP BY family) WHERE a = 0 AND c > 0""")
def _(t: Tables):
    k = F.col("p_partkey")
    one = F.when((k % 70 == 0) & (k > 0), 1).otherwise(0)
    s = t.part.select(
        F.when(k % 50 == 0, F.concat(F.lit("bad id "), k)).otherwise(F.concat(F.lit("S"), k - one)).alias("id"),
        F.concat(F.lit("IS "), F.floor(k / 2) * 2).alias("number"), F.when(k % 40 == 0, " ").otherwise(F.col("p_name")).alias("title"),
        F.col("p_type").alias("scope"), F.when(k % 30 == 0, "draft").when(k % 30 == 1, "superseded").otherwise("active").alias("status"),
        F.when(k % 60 == 0, "x").otherwise("2001-02-03").alias("last_amended"),
        F.when(k % 80 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand")).alias("keywords"),
        F.when(k % 30 == 1, F.concat(F.lit("IS "), k + 1)).alias("superseded_by_number"), F.concat(F.lit("F"), k % 600).alias("family"))
    return C.validate(s, W.edges(t))


@query("conformed_schema", "SELECT concat('S', s_suppkey) AS id, s_name AS title, 'active' AS status, coalesce(CASE WHEN s_acctbal > 0 THEN s_acctbal END, 0.0) AS balance, NULL::VARCHAR AS scope FROM supplier")
def _(t: Tables):
    s = t.supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("id"), "s_name", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("balance"))
    return C.conform(s, {"id": "string", "title": "string", "status": "string", "balance": "double", "scope": "string"},
                     {"s_name": "title"}, {"status": F.lit("active"), "balance": F.lit(0.0)})


@query("body_boilerplate_drop", """SELECT conv_id, turn FROM conversations WHERE length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) >= 120 AND turn % 2 = 0""")
def _(t: Tables):
    text = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("FOREWORD "), "text")).otherwise(F.col("text"))
    d = t.conversations.select("conv_id", "turn", E.body_passages(F.regexp_replace(text, r"\d", "")).alias("p"))
    return d.filter(F.size("p") > 0).select("conv_id", "turn")
