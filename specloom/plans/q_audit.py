"""Draft-audit queries over purchase drafts derived from order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from specloom.functions import scoring as S
from specloom.functions import vocab as V
from specloom.functions.encode import hashing_encoder
from specloom.functions.numbers import extract_citations
from specloom.operators import audit as A
from specloom.operators import fusion, graph
from specloom.operators.bm25 import build_bm25
from specloom.plans import views as W
from specloom.plans.q_graph import lint_corpus
from specloom.plans.registry import Tables, query
from specloom.session import cut_lineage

QCO = """lc AS (SELECT sts.*, CASE WHEN superseded_by IS NOT NULL THEN CASE WHEN key % 2 = 0 THEN 'recorded' ELSE 'derived_from_edition_year' END END AS source,
 CASE key % 5 WHEN 0 THEN 'mandatory' WHEN 1 THEN 'voluntary' WHEN 2 THEN 'no_qco_identified' ELSE 'unknown' END AS cert, CASE key % 5 WHEN 0 THEN 'ISI' WHEN 1 THEN 'CRS' END AS scheme FROM sts)"""
RESOLVED = """ex AS (SELECT base, edition_year AS year, min(id) AS eid FROM lc GROUP BY base, edition_year),
be AS (SELECT base, arg_max(id, k) AS bid FROM (SELECT base, min(id) AS id, (status = 'active')::INT * 100000 + edition_year AS k FROM lc GROUP BY base, status, edition_year) GROUP BY base),
rc AS (SELECT c.*, CASE WHEN c.part IS NULL THEN coalesce(eid, bid) END AS standard_id FROM cite c LEFT JOIN ex ON ex.base = c.base::INT AND ex.year = c.year LEFT JOIN be ON be.base = c.base::INT),
fm AS (SELECT doc, standard_id, arg_min(raw, "start") AS raw, min("start") AS "start", arg_min("end", "start") AS "end" FROM rc WHERE standard_id IS NOT NULL GROUP BY doc, standard_id)"""
AUDIT = (W.STD, W.STATUS, QCO, W.DRAFT, W.CITE, RESOLVED)
K1 = """SELECT doc, 'unresolved_citation' AS rule_id, 'medium' AS severity, concat(raw, ' is not in the corpus') AS message, "start", "end", raw AS evidence, 'Check the number in the catalogue.' AS suggested_fix, NULL AS standard_id FROM rc WHERE standard_id IS NULL"""
K2 = """SELECT rc.doc, 'superseded_citation', CASE WHEN l.source = 'derived_from_edition_year' THEN 'medium' ELSE 'high' END, concat(raw, ' is ', l.status), "start", "end", raw, concat('Cite ', n.number), standard_id FROM rc JOIN lc l ON l.id = rc.standard_id JOIN lc n ON n.id = l.superseded_by"""
K3 = """SELECT f.doc, 'missing_allied_standard', 'medium', concat(f.raw, ' needs ', n.number, ' as ', lower(e.type)), f."start", f."end", f.raw, concat('Add a reference to ', n.number), e.target_id FROM fm f JOIN edge e ON e.source_id = f.standard_id AND e.type IN ('NORMATIVE_REFERENCE', 'TEST_METHOD_FOR')
 JOIN lc n ON n.id = e.target_id WHERE NOT EXISTS (SELECT 1 FROM fm x WHERE x.doc = f.doc AND x.standard_id = e.target_id)"""
K4 = """SELECT f.doc, 'missing_certification_requirement', 'high', concat(raw, ' needs ', scheme, ' certification'), "start", "end", raw, concat('Require a valid ', scheme, ' mark under ', coalesce(r_name, 'the applicable order')), standard_id FROM fm f JOIN lc l ON l.id = f.standard_id AND cert = 'mandatory'
 LEFT JOIN region ON r_regionkey = l.key % 7 WHERE f.doc NOT IN (SELECT doc FROM draft WHERE contains(lower(text), 'standard mark'))"""
K5 = """SELECT doc, 'certification_unverified', 'low', concat('Certification not checked for ', array_to_string(list_sort(ns)[1:6], ', '), CASE WHEN len(ns) > 6 THEN concat(', and ', len(ns) - 6, ' more') ELSE '' END), NULL, NULL, NULL, 'Check the published orders before issuing.', NULL FROM (SELECT doc, list(DISTINCT l.number) AS ns FROM fm f JOIN lc l ON l.id = f.standard_id AND cert = 'unknown' GROUP BY doc)"""

ITEMS = r"""ln AS (SELECT doc, unnest(range(1, 5)) AS i, string_split(text, chr(10)) AS ls FROM draft),
li AS (SELECT doc, ls[i] AS raw, coalesce(list_sum(list_transform(ls[1:i-1], lambda s: length(s) + 1)), 0) AS off FROM ln WHERE i <= len(ls)),
it AS (SELECT doc, item, (off + instr(raw, item) - 1)::INT AS "start", (off + instr(raw, item) - 1 + length(item))::INT AS "end" FROM (SELECT *, trim(regexp_replace(trim(raw), '^\s*(?:[-*•]|\(?[a-zA-Z0-9]{1,3}[\).:]|\d+\.)\s*', '')) AS item FROM li)
 WHERE length(item) >= 4 AND NOT regexp_matches(item, '(?i)\b(IS\s*/\s*(?:IEC|ISO)|IS|BIS)\s*:?\s*\d{2,5}')),
qi AS (SELECT DISTINCT item AS query, item AS text FROM it), sc AS (SELECT id AS doc, concat(number, ' ', title) AS text, status FROM lc)"""
HITS = (ITEMS, W.bm25_cte("sc", "qi", stop=V.STOPWORDS), W.encode_cte("qv", "qi", "query"), W.encode_cte("dv", "sc", "doc"),
        """prs AS (SELECT q.query, d.doc, d.status FROM qi q CROSS JOIN sc d), sim AS (SELECT p.query, p.doc, p.status, round(coalesce(s, 0), 9) AS similarity FROM prs p LEFT JOIN (SELECT query, doc, sum(qv.w * dv.w) AS s FROM qv JOIN dv USING (bucket) GROUP BY query, doc) USING (query, doc)),
rk AS (SELECT s.query, s.doc, s.status, similarity, row_number() OVER (PARTITION BY s.query ORDER BY similarity DESC, s.doc) AS sr, row_number() OVER (PARTITION BY s.query ORDER BY coalesce(c.score, 0) DESC, s.doc) AS lr, max(coalesce(c.score, 0)) OVER (PARTITION BY s.query) > 0 AS sig FROM sim s LEFT JOIN score c USING (query, doc)),
fz AS (SELECT *, round(CASE WHEN status <> 'active' THEN 0.6 ELSE 1.0 END * (CASE WHEN sig THEN 0.5 / (60 + lr) ELSE 0 END + 1.0 / (60 + sr)), 12) AS fs FROM rk),
top1 AS (SELECT query AS item, doc AS standard_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY fs DESC, doc) AS r FROM fz) WHERE r = 1)""")
K6 = """SELECT it.doc, 'uncited_item', 'medium', concat('No citation; ', n.number, ' appears applicable'), it."start", it."end", it.item, concat('Consider citing ', n.number), t.standard_id FROM it JOIN top1 t ON t.item = it.item AND similarity >= 0.45 JOIN lc n ON n.id = t.standard_id
 WHERE NOT EXISTS (SELECT 1 FROM fm x WHERE x.doc = it.doc AND x.standard_id = t.standard_id)"""


def parts(t: Tables):
    """(drafts, resolved citations, corpus) used by every rule."""
    return parts_and_tables(t)[:3]


def parts_and_tables(t: Tables):
    """(drafts, resolved citations, corpus, the corpus' edition tables)."""
    d, c = W.drafts(t), cut_lineage(lint_corpus(t))
    tables = A.edition_tables(c)
    return d, A.resolve_citations(extract_citations(d, "doc", "text"), c, tables), c, tables


def orders(t: Tables):
    return t.region.select(F.concat(F.lit("Q"), "r_regionkey").alias("order_id"), F.col("r_name").alias("order_name"))


def chain(c):
    return graph.resolve_chain(c.select("id", "status"), c.filter("superseded_by IS NOT NULL").select("id", F.col("superseded_by").alias("successor")))


def item_hits(t: Tables, lines, c):
    """Best record for every distinct uncited line item, by the full fused search."""
    items = cut_lineage(lines.select("item").distinct().select(F.col("item").alias("query"), F.col("item").alias("text")))
    corpus = cut_lineage(c.select(F.col("id").alias("doc"), F.concat("number", F.lit(" "), "title").alias("text"), "status"))
    vecs = [cut_lineage(hashing_encoder(df, key, "text")) for df, key in ((items, "query"), (corpus, "doc"))]
    hits = fusion.fused_search(items, corpus, build_bm25(corpus, "doc", "text", "stop"), *vecs, 1)
    return hits.select(F.col("query").alias("item"), F.col("doc").alias("standard_id"), "similarity")


ROLES = ["NORMATIVE_REFERENCE", "TEST_METHOD_FOR"]


@query("resolved_citations", W.cte(*AUDIT) + "SELECT doc, pos, raw, standard_id FROM rc")
def _(t: Tables):
    return parts(t)[1].select("doc", "pos", "raw", "standard_id")


@query("lint_unresolved", W.cte(*AUDIT) + K1)
def _(t: Tables):
    return A.lint_unresolved(parts(t)[1])


@query("lint_superseded", W.cte(*AUDIT) + "SELECT * FROM (" + K2 + ") x(doc, rule_id, severity, message, \"start\", \"end\", evidence, suggested_fix, standard_id)")
def _(t: Tables):
    _, r, c, tables = parts_and_tables(t)
    return A.lint_superseded(r, c, chain(c), A.citable(tables))


@query("lint_missing_allied", W.cte(*AUDIT, W.EDGE) + "SELECT * FROM (" + K3 + ") x(doc, rule_id, severity, message, \"start\", \"end\", evidence, suggested_fix, standard_id)")
def _(t: Tables):
    _, r, c = parts(t)
    return A.lint_missing_allied(r, W.edges(t), c, ROLES)


@query("lint_missing_mark", W.cte(*AUDIT) + "SELECT * FROM (" + K4 + ") x(doc, rule_id, severity, message, \"start\", \"end\", evidence, suggested_fix, standard_id)")
def _(t: Tables):
    d, r, c, tables = parts_and_tables(t)
    return A.lint_missing_mark(r, d, c, orders(t), A.citable(tables))


@query("lint_unverified", W.cte(*AUDIT) + "SELECT * FROM (" + K5 + ") x(doc, rule_id, severity, message, \"start\", \"end\", evidence, suggested_fix, standard_id)")
def _(t: Tables):
    _, r, c = parts(t)
    return A.lint_unverified(r, c)


@query("recommend_for_line_items", W.cte(*AUDIT, *HITS) + "SELECT item, standard_id, round(similarity, 6) AS similarity FROM top1")
def _(t: Tables):
    lines, c = A.uncited_items(W.drafts(t)), lint_corpus(t)
    return item_hits(t, lines, c).select("item", "standard_id", F.round("similarity", 6).alias("similarity"))


@query("lint_uncited_items", W.cte(*AUDIT, *HITS) + "SELECT * FROM (" + K6 + ") x(doc, rule_id, severity, message, \"start\", \"end\", evidence, suggested_fix, standard_id)")
def _(t: Tables):
    d, r, c = parts(t)
    lines = cut_lineage(A.uncited_items(d))
    return A.lint_uncited(lines, r, item_hits(t, lines, c), c, V.UNCITED_MIN_SIMILARITY)


ALL = " UNION ALL ".join((K1, K2, K3, K4, K5))


#: al: the findings of all six rules.
FINDINGS = W.stored(W.cte(*AUDIT, W.EDGE, *HITS, "al AS (" + ALL + " UNION ALL " + K6 + ")"), "cite", "rc", "fm", "edge", "it", "qi", "sc", "score", "sim", "rk", "top1")


def findings(t: Tables, d, ordered: bool = False):
    """Findings of all six rules over the drafts ``d``."""
    return A.lint(*inputs(t, d), ordered=ordered)


def counts(t: Tables, d):
    """``found_counts`` of all six rules over the drafts ``d``."""
    return A.found_counts(A.document_findings(*inputs(t, d), texts=False))


def inputs(t: Tables, d):
    """What ``lint`` takes for the drafts ``d``."""
    c = cut_lineage(lint_corpus(t))
    lines = cut_lineage(A.uncited_items(d))  # read for the items to search and for the findings
    return d, c, W.edges(t), orders(t), chain(c), item_hits(t, lines, c), ROLES, V.UNCITED_MIN_SIMILARITY, lines


@query("lint_findings", FINDINGS + "SELECT * FROM al")
def _(t: Tables):
    return findings(t, W.drafts(t), ordered=True)


@query("lint_summary", FINDINGS + """SELECT doc, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) AS total FROM al GROUP BY doc""")
def _(t: Tables):
    return counts(t, W.drafts(t)).drop("old")


@query("grounding_check", W.cte(W.DRAFT, W.CITE) + """SELECT DISTINCT doc, concat('IS ', base, CASE WHEN part IS NOT NULL THEN concat('-', part) ELSE '' END, CASE WHEN year IS NOT NULL THEN concat(':', year) ELSE '' END) AS number,
 year IS NOT NULL AND base::INT < 200 AS grounded FROM cite""")
def _(t: Tables):
    d = W.drafts(t)
    cand = d.select("doc", F.regexp_extract("text", r"(IS \d+:\d{4})\.", 1).alias("number"))
    return A.grounding_check(d, cand)


@query("certification_decision", W.cte(W.STD, W.STATUS, QCO) + "SELECT id, cert AS status FROM lc")
def _(t: Tables):
    return lint_corpus(t).select("id", S.certification_status("scheme", "mandatory", "qco_checked").alias("status"))


@query("unverified_numbers_capped", """SELECT o_custkey AS doc, concat(array_to_string(list_sort(ns)[1:6], ', '), CASE WHEN len(ns) > 6 THEN concat(', and ', len(ns) - 6, ' more') ELSE '' END) AS listed FROM (SELECT o_custkey, list(DISTINCT o_orderpriority || o_orderstatus) AS ns FROM orders GROUP BY o_custkey)""")
def _(t: Tables):
    o = t.orders.select(F.col("o_custkey").alias("doc"), F.concat("o_orderpriority", "o_orderstatus").alias("v"))
    return A.capped_list(o, "doc", "v", 6, "listed")


@query("explanation_text", W.cte(W.STD, W.STATUS, QCO) + """SELECT id, concat_ws(' ', concat(number, ' covers: ', title), concat('Match confidence is ', CASE WHEN price >= 950 THEN 'high' ELSE 'low' END, ' (semantic similarity ', printf('%.2f', (key % 100) / 100.0), ').'),
 CASE WHEN cert = 'mandatory' THEN concat('Note: ', scheme, ' certification is mandatory for this category.') END) AS text,
 CASE cert WHEN 'unknown' THEN concat(number, ': certification could not be determined.') WHEN 'no_qco_identified' THEN concat(number, ' needs no mandatory certification.') ELSE concat(number, ' falls under the ', scheme, ' scheme, ', CASE cert WHEN 'mandatory' THEN 'mandatory' ELSE 'not mandatory' END, '. Evidence is not recorded; check the notification.') END AS note FROM lc""")
def _(t: Tables):
    from specloom.operators.reporting import certification_note, explain_text
    c = lint_corpus(t).join(W.standards(t).select("id", "price"), "id")
    band = F.when(F.col("price") >= 950, "high").otherwise("low")
    status = S.certification_status("scheme", "mandatory", "qco_checked")
    return c.select("id", explain_text("number", "title", band, (F.col("key") % 100) / 100.0, F.when(status == "mandatory", F.col("scheme"))).alias("text"),
                    certification_note("number", status, "scheme", F.lit(False), F.lit(None).cast("array<string>"), F.lit(None).cast("string")).alias("note"))
