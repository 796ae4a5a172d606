"""Graph queries over standards (part) and edges (lineitem)."""

from __future__ import annotations

from pyspark.sql import functions as F

from specloom.functions import extract as E
from specloom.functions import numbers as N
from specloom.functions import vocab as V
from specloom.operators import corpus as C
from specloom.operators import graph as G
from specloom.operators.ranking import tasks_for
from specloom.plans import views as W
from specloom.plans.registry import Tables, query
from specloom.session import cut_lineage

STEPS = """steps AS (SELECT DISTINCT * FROM (
 SELECT source_id AS node, target_id AS next, type, CASE WHEN type = 'UNMAPPED_TYPE' THEN 'RELATED_UNCLASSIFIED' ELSE type END AS role FROM edge WHERE type IN ('NORMATIVE_REFERENCE', 'AMENDED_BY', 'RELATED_PRODUCT', 'UNMAPPED_TYPE')
 UNION ALL SELECT target_id, source_id, type, CASE WHEN type = 'UNMAPPED_TYPE' THEN 'RELATED_UNCLASSIFIED' ELSE type END FROM edge WHERE type IN ('TEST_METHOD_FOR', 'RELATED_PRODUCT', 'UNMAPPED_TYPE'))),
h1 AS (SELECT request, node, min(k) AS k FROM (SELECT s.id AS request, next AS node, concat(s.id, chr(1), next, chr(1), role, chr(1), t.type) AS k FROM std s JOIN steps t ON t.node = s.id WHERE next <> s.id) GROUP BY request, node),
h2 AS (SELECT request, node, min(k) AS k FROM (SELECT h.request, t.next AS node, concat(string_split(h.k, chr(1))[1], chr(1), string_split(h.k, chr(1))[2], chr(1), next, chr(1), role, chr(1), t.type) AS k FROM h1 h JOIN steps t ON t.node = h.node WHERE t.next <> h.request) x
 WHERE NOT EXISTS (SELECT 1 FROM h1 WHERE h1.request = x.request AND h1.node = x.node) GROUP BY request, node),
hops AS (SELECT request, node, 1 AS hop, string_split(k, chr(1)) AS a FROM h1 UNION ALL SELECT request, node, 2, string_split(k, chr(1)) FROM h2)"""


def seeds(t: Tables):
    return W.standards(t).select(F.col("id").alias("request"), F.col("id").alias("node"))


@query("graph_expand_two_hops", W.cte(W.STD, W.EDGE, STEPS) + "SELECT request, node, hop, array_to_string(a[1:len(a) - 2], '>') AS path, a[len(a) - 1] AS role FROM hops")
def _(t: Tables):
    out = G.expand(seeds(t), G.orient(W.edges(t)), 2)
    return out.select("request", "node", "hop", F.array_join("path", ">").alias("path"), "role")


@query("graph_unmapped_types", W.cte(W.STD, W.EDGE, STEPS) + "SELECT a[len(a)] AS type, count(*) AS n FROM hops WHERE hop = 1 AND a[len(a) - 1] = 'RELATED_UNCLASSIFIED' GROUP BY 1")
def _(t: Tables):
    return G.unmapped_types(G.expand(seeds(t), G.orient(W.edges(t)), 1))


CHAIN = (W.STD, W.EDGE, """st AS (SELECT id, CASE WHEN key % 5 <> 0 THEN 'active' WHEN key % 2 = 0 THEN 'superseded' ELSE 'withdrawn' END AS status FROM std),
su AS (SELECT source_id AS id, CASE WHEN length(target_id) % 2 = 1 AND target_id LIKE '%7' THEN target_id || 'X' ELSE target_id END AS successor FROM edge WHERE type = 'SUPERSEDED_BY')""")


def chain_inputs(t: Tables):
    std = W.standards(t)
    k = F.col("key")
    st = std.select("id", F.when(k % 5 != 0, "active").when(k % 2 == 0, "superseded").otherwise("withdrawn").alias("status"))
    tgt = F.col("target_id")
    lost = (F.length(tgt) % 2 == 1) & tgt.endswith("7")
    su = W.edges(t).filter("type = 'SUPERSEDED_BY'").select(F.col("source_id").alias("id"), F.when(lost, F.concat(tgt, F.lit("X"))).otherwise(tgt).alias("successor"))
    return st, su


@query("supersession_chains", "WITH RECURSIVE " + W.cte(*CHAIN)[5:].rstrip() + """, reach AS (SELECT s.id AS start, successor AS node FROM st s JOIN su ON su.id = s.id WHERE s.status <> 'active' AND successor <> s.id
 UNION SELECT r.start, su.successor FROM reach r JOIN st s ON s.id = r.node AND s.status <> 'active' JOIN su ON su.id = r.node WHERE su.successor <> r.start)
 SELECT start, node, CASE WHEN s.id IS NULL THEN 'unknown' WHEN status = 'active' THEN 'active' ELSE 'passed' END AS state FROM reach LEFT JOIN st s ON s.id = node UNION ALL SELECT id, id, 'active' FROM st WHERE status = 'active'""")
def _(t: Tables):
    return G.resolve_chain(*chain_inputs(t)).select("start", "node", "state")


@query("current_edition_exists", "WITH RECURSIVE " + W.cte(*CHAIN)[5:].rstrip() + """, reach AS (SELECT s.id AS start, successor AS node FROM st s JOIN su ON su.id = s.id WHERE s.status <> 'active' AND successor <> s.id
 UNION SELECT r.start, su.successor FROM reach r JOIN st s ON s.id = r.node AND s.status <> 'active' JOIN su ON su.id = r.node WHERE su.successor <> r.start)
 SELECT DISTINCT start AS id FROM reach JOIN st s ON s.id = node AND s.status = 'active' UNION ALL SELECT id FROM st WHERE status = 'active'""")
def _(t: Tables):
    return G.first_active(G.resolve_chain(*chain_inputs(t))).select("id")


@query("direct_supersession", W.cte(W.STD, W.EDGE) + """SELECT s.id, (SELECT min(target_id) FROM edge e WHERE e.source_id = s.id AND type = 'SUPERSEDED_BY') AS successor,
 (SELECT count(*) FROM edge e WHERE e.source_id = s.id AND type = 'SUPERSEDED_BY') AS n_successors, (SELECT count(*) FROM edge e WHERE e.target_id = s.id AND type = 'SUPERSEDED_BY') AS n_predecessors FROM std s""")
def _(t: Tables):
    return G.supersession(W.standards(t), W.edges(t))


WAYS = "ways AS (SELECT source_id AS id, target_id AS other, type, 'forward' AS direction FROM edge UNION ALL SELECT target_id, source_id, type, 'inverse' FROM edge)"


def half(t: Tables):
    """Standards with an even key and their state: the other half of the edge ends is not held."""
    return W.standards(t).filter("key % 2 = 0").withColumn("status", F.when(F.col("key") % 3 == 0, "superseded").otherwise("active"))


def every(t: Tables):
    """All standards and their state."""
    return W.standards(t).withColumn("status", F.when(F.col("key") % 3 == 0, "superseded").otherwise("active"))


EVERY = "held AS (SELECT *, CASE WHEN key % 3 = 0 THEN 'superseded' ELSE 'active' END AS status FROM std)"
HALF = "half AS (SELECT *, CASE WHEN key % 3 = 0 THEN 'superseded' ELSE 'active' END AS status FROM std WHERE key % 2 = 0)"


@query("allied_neighbours", W.cte(W.STD, W.EDGE, WAYS, EVERY) + "SELECT w.id, type, direction, other, number, title, status FROM ways w JOIN held h ON h.id = w.other")
def _(t: Tables):
    return G.grouped_allied(W.edges(t), every(t)).select("id", "type", "direction", "other", "number", "title", "status")


@query("allied_counts_all_types", W.cte(W.STD, W.EDGE, WAYS, EVERY) + """SELECT id, type, sum(n)::BIGINT AS n FROM (SELECT w.id, type, 1 AS n FROM ways w JOIN held h ON h.id = w.other
 UNION ALL SELECT id, unnest(['NORMATIVE_REFERENCE','TEST_METHOD_FOR','TERMINOLOGY_FOR','SAFETY_REQUIREMENT_FOR','INSTALLATION_GUIDE_FOR','RELATED_PRODUCT']), 0 FROM held) GROUP BY id, type""")
def _(t: Tables):
    return G.allied_counts(W.edges(t), every(t), ["NORMATIVE_REFERENCE", "TEST_METHOD_FOR", "TERMINOLOGY_FOR",
                                                 "SAFETY_REQUIREMENT_FOR", "INSTALLATION_GUIDE_FOR", "RELATED_PRODUCT"])


@query("edges_in_reading_order", W.cte(W.EDGE) + """SELECT source_id, target_id, type, row_number() OVER (PARTITION BY source_id ORDER BY CASE type WHEN 'RELATED_PRODUCT' THEN 1 WHEN 'NORMATIVE_REFERENCE' THEN 2 ELSE 3 END, target_id) AS position
 FROM edge WHERE type IN ('RELATED_PRODUCT', 'NORMATIVE_REFERENCE', 'AMENDED_BY')""")
def _(t: Tables):
    return G.group_edges(W.edges(t), ["RELATED_PRODUCT", "NORMATIVE_REFERENCE", "AMENDED_BY"]).select("source_id", "target_id", "type", "position")


REFN = "rn AS (SELECT concat('S', l_partkey) AS id, concat('IS ', 100 + l_suppkey % 100, ':', 1960 + l_linenumber) AS number FROM lineitem)"


@query("related_with_outside", W.cte(W.STD, W.EDGE, WAYS, EVERY, REFN) + """, a AS (SELECT DISTINCT w.id, other, number FROM ways w JOIN held h ON h.id = w.other WHERE direction = 'forward')
 SELECT DISTINCT id, 'depends_on' AS part, other, false AS outside_corpus FROM a UNION ALL SELECT DISTINCT w.id, 'referenced_by', other, false FROM ways w JOIN held h ON h.id = w.other WHERE direction = 'inverse' AND w.id IN (SELECT id FROM held)
 UNION ALL SELECT DISTINCT id, 'outside_corpus', number, true FROM rn WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.id = rn.id AND a.number = rn.number)""")
def _(t: Tables):
    refs = t.lineitem.select(F.concat(F.lit("S"), "l_partkey").alias("id"), F.concat(F.lit("IS "), F.col("l_suppkey") % 100 + 100, F.lit(":"), F.col("l_linenumber") + 1960).alias("number"))
    return G.related(every(t), W.edges(t), refs).select("id", "part", "other", "outside_corpus")


@query("researched_flag", W.cte(W.STD, W.EDGE) + "SELECT id, id IN (SELECT source_id FROM edge) OR key % 11 = 0 AS researched FROM std")
def _(t: Tables):
    s = W.standards(t)
    return G.researched(s, W.edges(t), s.filter("key % 11 = 0").select("id"))


@query("dangling_edges", W.cte(W.STD, W.EDGE, HALF) + """SELECT source_id, target_id, type, 'source_id' AS missing FROM edge WHERE source_id NOT IN (SELECT id FROM half)
 UNION ALL SELECT source_id, target_id, type, 'target_id' FROM edge WHERE target_id NOT IN (SELECT id FROM half)""")
def _(t: Tables):
    return G.dangling(W.edges(t), half(t))


@query("overlap_pairs", W.cte(W.STD, W.EDGE, EVERY) + """SELECT DISTINCT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM edge WHERE type = 'OVERLAPS_SCOPE_WITH'
 AND source_id IN (SELECT id FROM held) AND target_id IN (SELECT id FROM held)""")
def _(t: Tables):
    return G.overlap_pairs(W.edges(t), every(t))


@query("incident_edges", W.cte(W.STD, W.EDGE, WAYS, EVERY) + "SELECT id, other, type, direction FROM ways WHERE id IN (SELECT id FROM held)")
def _(t: Tables):
    return G.incident_edges(every(t), W.edges(t))


@query("certification_rules_for", W.cte(W.STD) + """, r AS (SELECT s_suppkey AS rule_id, CASE WHEN s_suppkey % 2 = 0 THEN concat('IS ', 100 + s_suppkey % 100, ':', 1961 + s_suppkey % 50) END AS number, CASE s_nationkey % 3 WHEN 0 THEN 'economy' WHEN 1 THEN 'small' ELSE 'promo' END AS category FROM supplier)
 SELECT DISTINCT s.id, rule_id FROM std s JOIN r ON (r.number IS NOT NULL AND r.number = s.number) OR (r.number IS NULL AND r.category = s.category)""")
def _(t: Tables):
    k = F.col("s_suppkey")
    rules = t.supplier.select(k.alias("rule_id"), F.when(k % 2 == 0, F.concat(F.lit("IS "), k % 100 + 100, F.lit(":"), k % 50 + 1961)).alias("standard_number"),
                              F.when(F.col("s_nationkey") % 3 == 0, "economy").when(F.col("s_nationkey") % 3 == 1, "small").otherwise("promo").alias("category"))
    return G.rules_for(W.standards(t), rules)


@query("edges_from_references", W.cte(W.STD, W.SCAN, W.EDGE) + """, y AS (SELECT base, edition_year, min(id) AS id, key % 3 <> 0 AS act FROM std GROUP BY base, edition_year, key % 3 <> 0),
 pick AS (SELECT base, arg_max(id, act::INT * 100000 + edition_year) AS id FROM y GROUP BY base), cur AS (SELECT source_id, target_id, type FROM edge WHERE type = 'NORMATIVE_REFERENCE'),
 r AS (SELECT n, unnest([n3, n5, n7]) AS rn FROM scan), m AS (SELECT DISTINCT a.id AS source_id, b.id AS target_id FROM r JOIN pick a ON a.base = r.n JOIN pick b ON b.base = r.rn WHERE a.id <> b.id)
 SELECT source_id, target_id, type, 'curated' AS origin FROM cur UNION ALL SELECT source_id, target_id, 'normative_reference', 'extracted_from_annex' FROM m WHERE NOT EXISTS (SELECT 1 FROM cur c WHERE c.source_id = m.source_id AND c.target_id = m.target_id)""")
def _(t: Tables):
    d = W.scanned(t)
    own = N.item_id_fields("item_id")["number"]
    both = d.select(own.alias("base"), E.annex_references("text", own).alias("a"), E.clause_references("text", own).alias("c"))
    refs = both.select("base", F.lit(None).cast("string").alias("part"), F.explode(E.all_references("a", "c")).alias("r")).select(
        "base", "part", F.col("r.number").alias("ref_base"), F.col("r.part").alias("ref_part"))
    s = W.standards(t)
    corpus = s.select("id", F.col("base").cast("string").alias("base"), F.lit("").alias("part"),
                      F.when(F.col("key") % 3 != 0, "active").otherwise("superseded").alias("status"), "edition_year")
    return G.build_edges(refs, corpus, W.edges(t).filter("type = 'NORMATIVE_REFERENCE'"))


@query("edge_import_outcomes", W.cte(W.STD, W.EDGE, HALF) + """, r AS (SELECT source_id, target_id, CASE WHEN type = 'AMENDED_BY' THEN ' ' ELSE type END AS type FROM edge), ex AS (SELECT source_id, target_id, type FROM edge WHERE type = 'RELATED_PRODUCT')
 SELECT r.source_id, r.target_id, r.type, CASE WHEN trim(r.type) = '' THEN 'invalid' WHEN r.source_id NOT IN (SELECT id FROM half) OR r.target_id NOT IN (SELECT id FROM half) THEN 'dangling' WHEN r.type = 'RELATED_PRODUCT' THEN 'exists' ELSE 'inserted' END AS outcome,
 r.type NOT IN (' ', 'UNMAPPED_TYPE') AS mapped FROM (SELECT DISTINCT * FROM r) r""")
def _(t: Tables):
    e = W.edges(t)
    rows = e.withColumn("type", F.when(F.col("type") == "AMENDED_BY", " ").otherwise(F.col("type")))
    return G.import_edges(rows, half(t), e.filter("type = 'RELATED_PRODUCT'"))


CAT_SQL = """, e AS (SELECT source_id AS id, min(target_id) AS c FROM edge WHERE type = 'UNMAPPED_TYPE' GROUP BY source_id), s AS (SELECT std.id, CASE WHEN key % 4 > 0 THEN category END AS category, c FROM std LEFT JOIN e USING (id))"""


@query("category_by_property_or_edge", W.cte(W.STD, W.EDGE) + CAT_SQL + " SELECT id, 'property' AS strategy, coalesce(category, c) AS category FROM s UNION ALL SELECT id, 'edge', coalesce(c, category) FROM s")
def _(t: Tables):
    s = W.standards(t).withColumn("category", F.when(F.col("key") % 4 > 0, F.col("category")))
    e = W.edges(t).filter("type = 'UNMAPPED_TYPE'").withColumn("type", F.lit("BELONGS_TO"))
    a = G.category_of(s, e).withColumn("strategy", F.lit("property"))
    return a.unionByName(G.category_of(s, e, "edge").withColumn("strategy", F.lit("edge"))).select("id", "strategy", "category")


AMD = """am0 AS (SELECT concat('S', l_partkey) AS id, concat('A', l_linenumber) AS amendment_number, CAST(l_shipdate AS DATE) AS date_issued, concat('t', l_suppkey) AS summary FROM lineitem),
g0 AS (SELECT source_id AS id, s.number AS amendment_number, make_date(1990 + (s.key % 20)::INT, 1, 1) AS date_issued, s.title AS summary FROM edge JOIN std s ON s.id = edge.target_id WHERE type = 'AMENDED_BY' AND s.key % 4 > 0),
am AS (SELECT id, amendment_number, date_issued, min_by(summary, concat(p, summary)) AS summary FROM (SELECT *, 0 AS p FROM am0 UNION ALL SELECT *, 1 FROM g0) GROUP BY id, amendment_number, date_issued)"""


def amendments(t: Tables):
    table = t.lineitem.select(F.concat(F.lit("S"), "l_partkey").alias("id"), F.concat(F.lit("A"), "l_linenumber").alias("amendment_number"),
                              F.col("l_shipdate").cast("date").alias("date_issued"), F.concat(F.lit("t"), "l_suppkey").alias("summary"))
    k = F.col("key")
    s = W.standards(t).withColumn("last_amended", F.when(k % 4 > 0, F.concat(k % 20 + 1990, F.lit("-01-01"))).otherwise("soon"))
    return G.union_amendments(table, G.graph_amendments(W.edges(t), s))


@query("amendments_of_both_sources", W.cte(W.STD, W.EDGE, AMD) + "SELECT id, amendment_number, date_issued::VARCHAR AS date_issued, summary FROM am")
def _(t: Tables):
    return amendments(t).select("id", "amendment_number", F.col("date_issued").cast("string").alias("date_issued"), "summary")


@query("version_status", W.cte(W.STD, W.STATUS, W.EDGE, AMD) + """SELECT s.id, coalesce(x.number, s.number) AS current_edition, s.status = 'active' AS is_current, x.number AS superseded_by, false AS withdrawn, coalesce(c.n, 0) AS n_amendments, c.d::VARCHAR AS latest_amendment,
 s.key % 3 = 0 AND s.d <= 365 AS data_verified, CASE WHEN s.key % 3 = 0 THEN CASE WHEN s.d <= 365 THEN NULL ELSE 'stale_check' END WHEN s.key % 3 = 1 THEN 'unchecked_source' ELSE 'no_provenance' END AS verification_reason
 FROM (SELECT *, (key % 700) AS d FROM sts) s LEFT JOIN std x ON x.id = s.superseded_by LEFT JOIN (SELECT id, count(*) AS n, max(date_issued) AS d FROM am GROUP BY id) c ON c.id = s.id""")
def _(t: Tables):
    s = lint_corpus(t)
    k = F.col("key")
    as_of = F.lit("2020-01-01").cast("date")
    s = s.withColumn("source_url", F.when(k % 3 < 2, "u")).withColumn("checked_at", F.when(k % 3 == 0, F.date_sub(as_of, (k % 700).cast("int"))))
    return G.version_status(s, amendments(t), as_of).withColumn("latest_amendment", F.col("latest_amendment").cast("string"))


@query("amendment_status", W.cte(W.STD) + """, r AS (SELECT concat('S', p_partkey) AS id, CASE WHEN p_partkey % 4 > 0 THEN p_size % 3 END AS c FROM part WHERE p_partkey % 2 = 0), a AS (SELECT concat('S', l_partkey) AS id, max(l_linenumber) AS no FROM lineitem GROUP BY 1)
 SELECT std.id, r.id IS NOT NULL AS checked, c AS count, CASE WHEN r.id IS NOT NULL THEN no END AS latest_no, concat(number, CASE WHEN coalesce(c, 0) = 0 THEN '' WHEN no IS NULL THEN concat(', incorporating all ', c, ' published amendment', CASE WHEN c > 1 THEN 's' ELSE '' END)
 WHEN c = 1 THEN concat(', incorporating Amendment No. ', no, ' (May 2001)') ELSE concat(', incorporating all ', c, ' amendments, latest (Amendment No. ', no, ', May 2001)') END) AS citation FROM std LEFT JOIN r USING (id) LEFT JOIN a USING (id)""")
def _(t: Tables):
    from specloom.functions.text import readable_month
    s = W.standards(t)
    k = F.col("p_partkey")
    r = t.part.filter(k % 2 == 0).select(F.concat(F.lit("S"), k).alias("id"), F.when(k % 4 > 0, F.col("p_size") % 3).alias("count"))
    a = t.lineitem.select(F.concat(F.lit("S"), "l_partkey").alias("id"), F.col("l_linenumber").alias("no"), F.lit("2001-05").alias("date"))
    out = G.amendment_status(s, r, a)
    return out.select("id", "checked", "count", "latest_no", N.counted_citation("number", "count", "latest_no", readable_month("latest_date")).alias("citation"))


@query("edge_type_report", W.cte(W.EDGE) + "SELECT type, count(*) AS n, type <> 'UNMAPPED_TYPE' AS mapped FROM edge GROUP BY type")
def _(t: Tables):
    return G.edge_type_report(W.edges(t))


EGO = (W.STD, W.EDGE, WAYS, "nb AS (SELECT DISTINCT id AS request, other AS node FROM ways WHERE other <> id UNION SELECT id, id FROM std)")


@query("ego_network_edges", W.cte(*EGO) + "SELECT request, type, count(*) AS n FROM (SELECT a.request, e.* FROM edge e JOIN nb a ON a.node = e.source_id JOIN nb b ON b.node = e.target_id AND b.request = a.request) GROUP BY request, type")
def _(t: Tables):
    _, e = G.ego_network(seeds(t), W.edges(t), 1)
    return e.groupBy("request", "type").agg(F.count(F.lit(1)).alias("n"))


@query("ego_network_kinds", W.cte(*EGO) + "SELECT request, category AS kind, count(*) AS n FROM nb JOIN std ON std.id = nb.node GROUP BY request, category")
def _(t: Tables):
    nodes = cut_lineage(G.ego_nodes(seeds(t), W.edges(t), 1).select("request", "node"))
    n = tasks_for(t.spark, nodes.count())
    kinds = W.standards(t).select(F.col("id").alias("node"), F.col("category").alias("kind"))
    named = nodes.repartition(n, "node").join(kinds.repartition(n, "node"), "node")
    return named.repartition(n, "request").groupBy("request", "kind").agg(F.count(F.lit(1)).alias("n"))


SEL = """sel AS (SELECT o_custkey AS project, concat('IS ', l_partkey) AS code, p_name AS title, ['primary','test','safety','installation','certification','other'][(l_suppkey % 6 + 1)::INT] AS role,
 CASE WHEN l_linenumber % 3 = 0 THEN 'superseded' ELSE 'latest' END AS version, CASE WHEN l_partkey % 2 = 0 THEN concat('A', l_partkey % 5) END AS amendment FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
sel1 AS (SELECT project, code, title, role, min(version) AS version, min(amendment) AS amendment FROM sel GROUP BY project, code, title, role)"""


def selection(t: Tables):
    li = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey", "l_linenumber")
    j = li.join(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey").join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    roles = F.array(*[F.lit(r) for r in ("primary", "test", "safety", "installation", "certification", "other")])
    rows = j.select(F.col("o_custkey").alias("project"), F.concat(F.lit("IS "), "l_partkey").alias("code"), F.col("p_name").alias("title"),
                    F.get(roles, (F.col("l_suppkey") % 6).cast("int")).alias("role"),
                    F.when(F.col("l_linenumber") % 3 == 0, "superseded").otherwise("latest").alias("version"),
                    F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("A"), F.col("l_partkey") % 5)).alias("amendment"))
    return rows.groupBy("project", "code", "title", "role").agg(F.min("version").alias("version"), F.min("amendment").alias("amendment"))


@query("selection_gaps", W.cte(SEL) + """, f AS (SELECT project, bool_or(role = 'primary') AS p, bool_or(role = 'test') AS t FROM sel1 GROUP BY project)
 SELECT project, 'no_primary' AS rule, 'critical' AS severity, NULL AS code FROM f WHERE NOT p UNION ALL SELECT project, 'no_test_method', 'warn', NULL FROM f WHERE NOT t
 UNION ALL SELECT project, 'electrical_without_safety', 'warn', NULL FROM (SELECT project, bool_or(regexp_matches(title, 'gear')) AS e, bool_or(role IN ('safety', 'installation')) AS s FROM sel1 GROUP BY project) WHERE e AND NOT s
 UNION ALL SELECT project, 'superseded_selected', 'critical', code FROM sel1 WHERE version = 'superseded'""")
def _(t: Tables):
    s = selection(t)
    return G.selection_gaps(s.withColumn("title", F.regexp_replace("title", "gear", "electric gear")))


@query("clause_fragments", W.cte(SEL) + """, r AS (SELECT *, list_position(['primary','test','safety','installation','certification'], role) AS no FROM sel1 WHERE role <> 'other'),
 c AS (SELECT project, role, dense_rank() OVER (PARTITION BY project ORDER BY no) AS clause, row_number() OVER (PARTITION BY project, role ORDER BY code) AS position, concat(code, CASE WHEN amendment IS NOT NULL THEN concat(' including ', amendment) ELSE '' END) AS name FROM r)
 SELECT project, clause, position, CASE WHEN position > 1 THEN concat(CASE role WHEN 'primary' THEN ' and ' ELSE ', ' END, name) ELSE concat(clause, '. ', CASE role WHEN 'primary' THEN 'The item shall conform in all respects to ' WHEN 'test' THEN 'Type and routine tests shall follow '
 WHEN 'safety' THEN 'The item shall also comply with ' WHEN 'installation' THEN 'Installation shall follow ' ELSE 'The item shall carry a valid mark under ' END, name) END AS fragment FROM c
 UNION ALL SELECT project, clause, 0, CASE role WHEN 'test' THEN ', with certificates from an accredited laboratory for each lot.' WHEN 'certification' THEN '; state the licence number in the bid.' ELSE '.' END FROM c WHERE position = 1""")
def _(t: Tables):
    return G.clause_fragments(selection(t))


def lint_corpus(t: Tables):
    """Standards with the state their editions imply and a three-state certification record."""
    null = F.lit(None).cast("string")
    s = W.standards(t).withColumn("family", N.family_key("number")).withColumn("status", F.lit("active")).withColumn("superseded_by", null).withColumn("supersession_source", null)
    s = C.derive_supersession(s)
    k = F.col("key")
    return s.select(
        "id", "number", "title", "category", "edition_year", "status", "superseded_by", "key",
        F.when(F.col("supersession_source").isNotNull() & (k % 2 == 0), "recorded").otherwise(F.col("supersession_source")).alias("supersession_source"),
        F.when(k % 5 == 0, "ISI").when(k % 5 == 1, "CRS").alias("scheme"), F.when(k % 5 == 0, True).when(k % 5 == 1, False).alias("mandatory"),
        (k % 5 == 2).alias("qco_checked"), F.when(k % 5 == 0, F.concat(F.lit("Q"), k % 7)).alias("order_id"))


assert V.EDGE_TYPES  # the mapping the queries above rely on
