"""Scans, lookups, joins, counts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from specloom.functions import vocab as V
from specloom.operators import corpus as C
from specloom.operators import feedback as B
from specloom.operators import relational as R
from specloom.operators.ranking import exact_rank
from specloom.plans import views as W
from specloom.plans.q_graph import HALF, half
from specloom.plans.registry import Tables, query
from specloom.session import new_path
from specloom.sources import html as H
from specloom.sources import readers, writers


@query("projected_scan", "SELECT p_partkey, p_name FROM part WHERE p_size > 25")
def _(t: Tables):
    return readers.read_table(t.spark, f"{t.folder}/part.parquet", ["p_partkey", "p_name"], F.col("p_size") > 25)


@query("recent_events", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def _(t: Tables):
    return B.recent(t.events, 100, ["ts", "event_id"]).select("event_id", "user_id")


UPD = "u AS (SELECT p_partkey + 500 AS id, upper(p_name) AS title, p_brand AS brand FROM part WHERE p_partkey % 3 = 0), g AS (SELECT p_partkey AS id, p_name AS title, p_type AS brand FROM part)"


def updates(t: Tables):
    u = t.part.filter("p_partkey % 3 = 0").select((F.col("p_partkey") + 500).alias("id"), F.upper("p_name").alias("title"), F.col("p_brand").alias("brand"))
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("brand")), u


@query("upserted_table", W.cte(UPD) + "SELECT coalesce(g.id, u.id) AS id, coalesce(u.title, g.title) AS title, CASE WHEN g.id IS NULL THEN u.brand ELSE g.brand END AS brand FROM g FULL JOIN u ON g.id = u.id")
def _(t: Tables):
    g, u = updates(t)
    return R.upsert(g, u, ["id"], ["title"])


@query("insert_ignore", W.cte(W.EDGE) + "SELECT source_id, target_id, count(*) AS n FROM (SELECT source_id, target_id FROM edge WHERE type = 'RELATED_PRODUCT' UNION ALL SELECT DISTINCT source_id, target_id FROM edge e WHERE NOT EXISTS (SELECT 1 FROM edge x WHERE x.type = 'RELATED_PRODUCT' AND x.source_id = e.source_id AND x.target_id = e.target_id)) GROUP BY ALL")
def _(t: Tables):
    e = W.edges(t)
    out = R.insert_new(e.filter("type = 'RELATED_PRODUCT'"), e, ["source_id", "target_id"])
    return out.groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("n"))


@query("replaced_children", "SELECT l_orderkey AS parent, l_linenumber AS no, l_partkey AS part FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0) UNION ALL SELECT o_orderkey, 0, o_custkey FROM orders WHERE o_orderkey % 4 = 0")
def _(t: Tables):
    kids = t.lineitem.select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("no"), F.col("l_partkey").alias("part"))
    new = t.orders.filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("parent"), F.lit(0).alias("no"), F.col("o_custkey").alias("part"))
    return R.replace_children(kids, new, "parent")


@query("keyword_projection", "SELECT p_partkey, lower(concat_ws(' ', p_name, p_type, p_brand)) AS search_text, to_json({p_name: p_name, p_type: p_type, p_brand: p_brand})::VARCHAR AS document FROM part")
def _(t: Tables):
    return R.keyword_projection(t.part, "p_partkey", ["p_name", "p_type", "p_brand"])


@query("page_links", """SELECT DISTINCT page_id, regexp_replace(lower(unnest(regexp_extract_all(html, 'href="([^"]+)"', 1))), '\\.+$', '') AS item FROM pages""")
def _(t: Tables):
    return H.extract_links(t.pages, "page_id", "html", 'href="([^"]+)"')


@query("distinct_links", """SELECT DISTINCT regexp_replace(lower(unnest(regexp_extract_all(html, 'href="([^"]+)"', 1))), '\\.+$', '') AS item FROM pages""")
def _(t: Tables):
    return H.catalogue(H.extract_links(t.pages, "page_id", "html", 'href="([^"]+)"'))


@query("review_table_rows", """SELECT p_partkey AS key, 1 AS row, concat('IS ', p_partkey, ' : Part 1 : 1988') AS number, p_name AS title, p_type AS category, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand END AS superseded_by FROM part""")
def _(t: Tables):
    page = F.concat(F.lit("<table><tr><th>S.No.</th><th>No</th><th>Title</th><th>Cat</th></tr>\n<TR class='x'><td>1.</td><td><b>IS "), "p_partkey",
                    F.lit("</b> : Part 1\n : 1988</td><td>"), "p_name", F.lit("&nbsp;</td><td> "), "p_type", F.lit("</td><td>"),
                    F.when(F.col("p_partkey") % 2 == 0, "--").otherwise(F.col("p_brand")), F.lit("</td></TR><tr><td>9</td><td>short</td></tr></table>"))
    return H.review_rows(t.part.select(F.col("p_partkey").alias("key"), page.alias("html")), "key", "html")


@query("filtered_page", "SELECT p_partkey, p_name, (SELECT count(*) FROM part WHERE p_type = 'SMALL') AS total FROM part WHERE p_type = 'SMALL' ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 10")
def _(t: Tables):
    rows, total = R.page(t.part, {"p_type": "SMALL", "p_brand": None}, ["-p_retailprice", "p_partkey"], 20, 10)
    return rows.select("p_partkey", "p_name", F.lit(total).cast("bigint").alias("total"))


@query("contains_any_case", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'promo')")
def _(t: Tables):
    p = t.part.select("p_partkey", "p_name", F.array("p_brand", "p_type").alias("tags"))
    hit = R.contains_ci(p, ["p_name", "tags"], "RING").select("p_partkey")
    return hit.union(R.contains_ci(p, ["tags"], "Promo").select("p_partkey")).distinct()


BARE = "bare AS (SELECT id, concat('IS ', base) AS number, edition_year, CASE WHEN key % 4 = 0 THEN 'superseded' ELSE 'active' END AS status, key FROM std)"


def bare(t: Tables):
    return W.standards(t).select("id", F.concat(F.lit("IS "), "base").alias("number"), "edition_year", F.when(F.col("key") % 4 == 0, "superseded").otherwise("active").alias("status"))


@query("resolved_keys", W.cte(W.STD, BARE) + """, w AS (SELECT DISTINCT CASE l_linenumber % 4 WHEN 0 THEN concat('S', l_partkey) WHEN 1 THEN concat('is ', 95 + l_suppkey % 110) ELSE concat('IS ', 95 + l_suppkey % 110, ' : ', 1950 + l_partkey % 60) END AS wanted FROM lineitem),
 p AS (SELECT wanted, trim(lower(CASE WHEN contains(wanted, ':') THEN string_split(wanted, ':')[1] ELSE wanted END)) AS n, TRY_CAST(trim(string_split(wanted, ':')[2]) AS INTEGER) AS y FROM w),
 e AS (SELECT lower(number) AS n, edition_year AS y, min(id) AS eid FROM bare GROUP BY ALL), b AS (SELECT lower(number) AS n, arg_max(id, k) AS bid FROM (SELECT number, min(id) AS id, (status = 'active')::INT * 100000 + edition_year AS k FROM bare GROUP BY number, status, edition_year) GROUP BY 1)
 SELECT wanted, coalesce(o.id, eid, bid) AS id FROM p LEFT JOIN bare o ON o.id = wanted LEFT JOIN e ON e.n = p.n AND e.y = p.y LEFT JOIN b ON b.n = p.n""")
def _(t: Tables):
    k = F.col("l_linenumber") % 4
    w = t.lineitem.select(F.when(k == 0, F.concat(F.lit("S"), "l_partkey")).when(k == 1, F.concat(F.lit("is "), F.col("l_suppkey") % 110 + 95))
                          .otherwise(F.concat(F.lit("IS "), F.col("l_suppkey") % 110 + 95, F.lit(" : "), F.col("l_partkey") % 60 + 1950)).alias("wanted"))
    return R.resolve_keys(w, bare(t))


@query("known_sector_rows", "SELECT c_custkey, lower(c_mktsegment) AS segment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def _(t: Tables):
    m = t.customer.select(F.lower("c_mktsegment").alias("value")).distinct().filter(F.col("value").isin("building", "machinery")).withColumn("canonical", F.col("value"))
    good, _ = C.map_vocab(t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment")), "segment", m)
    return good


@query("unknown_sector_rows", "SELECT c_custkey, c_mktsegment AS segment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def _(t: Tables):
    m = t.customer.select(F.lower("c_mktsegment").alias("value")).distinct().filter(F.col("value").isin("building", "machinery")).withColumn("canonical", F.col("value"))
    return C.map_vocab(t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment")), "segment", m)[1]


@query("counts_by_department_and_category", W.cte(W.STD) + "SELECT department, category, count(*) AS n FROM std GROUP BY department, category")
def _(t: Tables):
    return R.counts(W.standards(t), "department", "category")


@query("duplicate_numbers", W.cte(W.STD) + "SELECT number, count(*) AS n FROM std GROUP BY number HAVING count(*) > 1")
def _(t: Tables):
    return C.duplicates(W.standards(t), "number")


@query("newest_in_family", W.cte(W.STD) + "SELECT base, arg_max(id, k) AS pick FROM (SELECT base, min(id) AS id, (key % 4 > 0)::INT * 100000 + edition_year AS k FROM std GROUP BY base, key % 4 > 0, edition_year) GROUP BY base")
def _(t: Tables):
    from specloom.operators.graph import best_edition
    s = W.standards(t).withColumn("status", F.when(F.col("key") % 4 == 0, "superseded").otherwise("active"))
    return best_edition(s, ["base"])


@query("category_rollup", W.cte(W.STD) + """SELECT c.category, coalesce(n, 0) AS n_standards, coalesce(r, 0) AS n_rules FROM (SELECT DISTINCT lower(c_mktsegment) AS category FROM customer UNION SELECT DISTINCT category FROM std) c
 LEFT JOIN (SELECT category, count(*) AS n FROM std GROUP BY category) USING (category) LEFT JOIN (SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'small' ELSE 'building' END AS category, count(*) AS r FROM supplier GROUP BY 1) USING (category)""")
def _(t: Tables):
    cats = t.customer.select(F.lower("c_mktsegment").alias("category")).union(W.standards(t).select("category"))
    rules = t.supplier.select(F.when(F.col("s_nationkey") % 2 == 0, "small").otherwise("building").alias("category"))
    return R.category_counts(W.standards(t), rules, cats)


@query("distinct_categories", W.cte(W.STD) + "SELECT DISTINCT category FROM std ORDER BY category")
def _(t: Tables):
    return W.standards(t).select("category").distinct().orderBy("category")


@query("entity_counts", W.cte(W.EDGE) + "SELECT 'standards' AS entity, count(*) AS n FROM part UNION ALL SELECT 'edges', count(*) FROM edge UNION ALL SELECT 'documents', count(*) FROM documents")
def _(t: Tables):
    return R.entity_counts({"standards": t.part, "edges": W.edges(t), "documents": t.documents})


@query("coverage", "SELECT count(*) FILTER (p_size % 3 = 0) AS checked, count(*) FILTER (p_size % 3 <> 0) AS unchecked, sum(coalesce(CASE WHEN p_size % 3 = 0 THEN p_size END, 0))::BIGINT AS total FROM part")
def _(t: Tables):
    return R.coverage(t.part, F.col("p_size") % 3 == 0, F.when(F.col("p_size") % 3 == 0, F.col("p_size")))


@query("hydrated_hits", W.cte(W.STD, HALF) + "SELECT l_orderkey, l_linenumber, id, number FROM lineitem JOIN half ON id = concat('S', l_partkey)")
def _(t: Tables):
    li = t.lineitem.select("l_orderkey", "l_linenumber", F.concat(F.lit("S"), "l_partkey").alias("id"))
    return li.join(half(t).select("id", "number"), "id").select("l_orderkey", "l_linenumber", "id", "number")


@query("successor_numbers", W.cte(W.STD, W.STATUS) + "SELECT s.id, s.superseded_by, x.number AS successor_number FROM sts s LEFT JOIN std x ON x.id = s.superseded_by")
def _(t: Tables):
    from specloom.plans.q_graph import lint_corpus
    return R.with_successor(lint_corpus(t)).select("id", "superseded_by", "successor_number")


@query("remapped_ids", "SELECT l_orderkey AS o, l_linenumber AS l, concat('N', l_partkey * 2) AS id, l_suppkey AS s FROM lineitem")
def _(t: Tables):
    old = t.part.select(F.concat(F.lit("S"), "p_partkey").alias("id"), F.col("p_partkey").alias("k"))
    new = t.part.select(F.concat(F.lit("N"), F.col("p_partkey") * 2).alias("id"), F.col("p_partkey").alias("k"))
    li = t.lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.concat(F.lit("S"), "l_partkey").alias("id"), F.col("l_suppkey").alias("s"))
    return R.remap_ids(li, "id", old, new, "k")


@query("remapped_id_lists", "SELECT l_orderkey AS o, l_linenumber AS l, l_suppkey AS s, l_partkey AS p, concat('N', l_partkey * 2, ',N', l_suppkey * 2) AS ids FROM lineitem")
def _(t: Tables):
    old = t.part.select(F.concat(F.lit("S"), "p_partkey").alias("id"), F.col("p_partkey").alias("k"))
    new = t.part.select(F.concat(F.lit("N"), F.col("p_partkey") * 2).alias("id"), F.col("p_partkey").alias("k"))
    li = t.lineitem.select(F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice").alias("key"),
                           F.array(F.concat(F.lit("S"), "l_partkey"), F.concat(F.lit("S"), "l_suppkey")).alias("ids"))
    out = R.remap_id_arrays(li, "key", "ids", old, new, "k")
    return out.select(F.col("key.l_orderkey").alias("o"), F.col("key.l_linenumber").alias("l"), F.col("key.l_suppkey").alias("s"),
                      F.col("key.l_partkey").alias("p"), F.array_join("ids", ",").alias("ids"))


@query("enriched_hits", W.cte(W.STD, HALF) + """SELECT l_orderkey AS query, h.id AS doc, l_linenumber AS rank, number, status, coalesce(a.n, 0) AS n_amendments, coalesce(r.n, 0) AS n_rules, CASE WHEN status <> 'active' THEN concat(number, ' is ', status) END AS warning FROM lineitem JOIN half h ON h.id = concat('S', l_partkey)
 LEFT JOIN (SELECT concat('S', s_suppkey) AS id, count(*) AS n FROM supplier GROUP BY 1) a ON a.id = h.id LEFT JOIN (SELECT concat('S', c_custkey) AS id, count(*) AS n FROM customer GROUP BY 1) r ON r.id = h.id""")
def _(t: Tables):
    hits = t.lineitem.select(F.col("l_orderkey").alias("query"), F.concat(F.lit("S"), "l_partkey").alias("doc"), F.col("l_linenumber").alias("rank"))
    am = t.supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("id"))
    ru = t.customer.select(F.concat(F.lit("S"), "c_custkey").alias("id"))
    return R.enrich(hits, half(t), am, ru)


@query("ids_per_sector", W.cte(W.STD) + "SELECT key, concat('IS-', upper(category), '-', lpad(row_number() OVER (PARTITION BY category ORDER BY number, id)::VARCHAR, 4, '0')) AS sid FROM std")
def _(t: Tables):
    return C.assign_ids(W.standards(t), "category", ["number", "id"], F.upper("category"), 4, "sid").select("key", "sid")


@query("first_per_number", W.cte(W.STD) + "SELECT number, min(key) AS key FROM std GROUP BY number")
def _(t: Tables):
    return R.dedupe_first(W.standards(t), ["number"], ["key"]).select("number", "key")


@query("event_ordinal_per_type", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events")
def _(t: Tables):
    return exact_rank(t.events.select("event_id", "event_type", "value"), ["event_type"], ["-value", "event_id"]).select("event_id", "rank")


@query("lead_score_gap", W.cte(W.STD) + "SELECT id, price - lead(price) OVER (PARTITION BY base ORDER BY price DESC, id) AS gap FROM std".replace("price - lead(price)", "round(price - lead(price)").replace(", id) AS", ", id), 6) AS"))
def _(t: Tables):
    # the next row of the same group by exact rank, as a self-join, so a hot group is not one window
    r = exact_rank(W.standards(t).select("id", "base", "price"), ["base"], ["-price", "id"])
    nxt = r.select("base", (F.col("rank") - 1).alias("rank"), F.col("price").alias("next"))
    return r.join(nxt, ["base", "rank"], "left").select("id", F.round(F.col("price") - F.col("next"), 6).alias("gap"))


@query("score_then_prior_score", "SELECT p_partkey AS id FROM part ORDER BY p_size DESC, p_retailprice DESC, p_partkey LIMIT 50")
def _(t: Tables):
    return t.part.orderBy(F.desc("p_size"), F.desc("p_retailprice"), "p_partkey").limit(50).select(F.col("p_partkey").alias("id"))


@query("rank_then_date", "SELECT o_orderkey AS id FROM orders ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey LIMIT 50")
def _(t: Tables):
    return t.orders.orderBy(F.desc("o_totalprice"), F.desc("o_orderdate"), "o_orderkey").limit(50).select(F.col("o_orderkey").alias("id"))


@query("union_of_sources", "SELECT source, count(*) AS n, count(title) AS titles, count(balance) AS balances FROM (SELECT 'part' AS source, p_name AS title, NULL AS balance FROM part UNION ALL SELECT 'supplier', s_name, s_acctbal FROM supplier UNION ALL SELECT 'customer', NULL, c_acctbal FROM customer) GROUP BY source")
def _(t: Tables):
    u = C.union_sources({"part": t.part.select(F.col("p_name").alias("title")), "supplier": t.supplier.select(F.col("s_name").alias("title"), F.col("s_acctbal").alias("balance")),
                         "customer": t.customer.select(F.col("c_acctbal").alias("balance"))})
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("title").alias("titles"), F.count("balance").alias("balances"))


@query("shared_queries", "SELECT text FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT text FROM documents WHERE doc_id % 2 = 1")
def _(t: Tables):
    return R.shared_values(t.documents.filter("doc_id % 2 = 0"), t.documents.filter("doc_id % 2 = 1"), "text")


@query("merged_keyword_arrays", "SELECT p_partkey, CASE WHEN lower(p_type) = split_part(p_name, ' ', 1) THEN p_name ELSE concat(split_part(p_name, ' ', 1), ' ', split_part(p_name, ' ', 2), ' ', lower(p_type)) END AS words FROM part")
def _(t: Tables):
    p = t.part.select("p_partkey", F.split("p_name", " ").alias("a"), F.array(F.split("p_name", " ")[1], F.lower("p_type")).alias("b"))
    return p.select("p_partkey", F.array_join(R.merge_arrays("a", "b"), " ").alias("words"))


@query("union_with_priority", "SELECT p_partkey % 100 AS k, p_name AS v FROM part WHERE p_partkey % 100 < 40 UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT p_partkey % 100 FROM part WHERE p_partkey % 100 < 40)")
def _(t: Tables):
    hi = t.part.filter("p_partkey % 100 < 40").select((F.col("p_partkey") % 100).alias("k"), F.col("p_name").alias("v"))
    return R.union_priority(hi, t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")), ["k"])


@query("json_log_round_trip", """SELECT count(*) FILTER (ok) AS good, count(*) FILTER (NOT ok) AS bad FROM (SELECT CASE event_type WHEN 'purchase' THEN event_id % 10 > 0 WHEN 'signup' THEN true WHEN 'view' THEN event_id % 7 > 0 ELSE true END AS ok FROM events)""")
def _(t: Tables):
    from specloom.plans.q_feedback import interactions
    path = new_path(t.spark, "log")
    logs = interactions(t)
    k = F.col("event_id")
    bad = (F.col("event_type") == "purchase") & (k % 10 == 0)
    broken = (F.col("event_type") == "view") & (k % 7 == 0)
    line = F.to_json(F.struct("query", "candidates_shown", F.when(~bad, F.col("chosen_id")).alias("chosen_id"), "action", "corrected_id", "timestamp", "source"))
    logs.select(F.when(broken, F.substring(line, 1, 40)).otherwise(line).alias("value")).write.text(path)
    good, rejected = readers.read_interactions(t.spark, path)
    both = good.select(F.lit(1).alias("g")).unionByName(rejected.select(F.lit(0).alias("g")))
    return both.agg(F.count_if(F.col("g") == 1).alias("good"), F.count_if(F.col("g") == 0).alias("bad"))


@query("appended_then_replaced_table", "SELECT l_returnflag AS flag, 2 * count(*) AS appended, count(*) AS kept FROM lineitem GROUP BY l_returnflag")
def _(t: Tables):
    json_path, table_path = new_path(t.spark, "audit"), new_path(t.spark, "table")
    rows = t.lineitem.select(F.col("l_returnflag").alias("flag"))
    for _ in range(2):
        writers.append_json(rows, json_path)
        writers.overwrite_table(rows, table_path)
    a = t.spark.read.schema("flag STRING").json(json_path).groupBy("flag").agg(F.count(F.lit(1)).alias("appended"))
    return a.join(t.spark.read.parquet(table_path).groupBy("flag").agg(F.count(F.lit(1)).alias("kept")), "flag")


@query("rebuilt_indexes", W.cte(W.BENCH, W.DOCS, W.EDGE, W.bm25_cte("dc", "bq", stop=V.STOPWORDS)) + "SELECT (SELECT count(*) FROM post) AS postings, (SELECT count(*) FROM idfs) AS terms, (SELECT count(*) FROM edge) AS edges, (SELECT count(*) FROM embeddings) AS vectors")
def _(t: Tables):
    from specloom.operators.bm25 import Bm25Index
    path = new_path(t.spark, "indexes")
    writers.rebuild_indexes(W.doc_corpus(t), W.edges(t), W.vectors(t), path)
    ix = Bm25Index.read(t.spark, f"{path}/bm25", "stop")

    counts = R.entity_counts({"postings": ix.postings, "terms": ix.terms, "edges": t.spark.read.parquet(f"{path}/edges"),
                              "vectors": t.spark.read.parquet(f"{path}/vectors")})
    return counts.agg(*[F.max(F.when(F.col("entity") == e, F.col("n"))).alias(e) for e in ("postings", "terms", "edges", "vectors")])
