"""Text, number and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from specloom.functions import numbers as N
from specloom.functions import scoring as S
from specloom.functions import text as X
from specloom.functions import vocab as V
from specloom.plans import views as W
from specloom.plans.registry import Tables, query

STOP_SQL = ",".join(f"'{w}'" for w in V.STOPWORDS)


def md5(c):
    return F.md5(c)


@query("tokens_alnum", "SELECT doc_id, len(k) AS n, md5(array_to_string(k, ' ')) AS h FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS k FROM documents)")
def _(t: Tables):
    k = X.tokens("text", "alnum")
    return t.documents.select("doc_id", F.size(k).cast("bigint").alias("n"), md5(F.array_join(k, " ")).alias("h"))


@query("tokens_without_stopwords", f"""SELECT doc_id, len(k) AS n, md5(array_to_string(k, ' ')) AS h FROM (SELECT doc_id,
 list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ({STOP_SQL})) AS k FROM documents)""")
def _(t: Tables):
    k = X.tokens("text", "stop")
    return t.documents.select("doc_id", F.size(k).cast("bigint").alias("n"), md5(F.array_join(k, " ")).alias("h"))


@query("tokens_hyphen", r"SELECT doc_id, len(k) AS n, md5(array_to_string(k, ' ')) AS h FROM (SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), '[À-ÖØ-öø-ɏ]', '_', 'g'), '\b[a-z0-9\-]+\b') AS k FROM documents)")
def _(t: Tables):
    k = X.tokens("text", "hyphen")
    return t.documents.select("doc_id", F.size(k).cast("bigint").alias("n"), md5(F.array_join(k, " ")).alias("h"))


@query("clean_whitespace", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", md5(X.clean_ws("text")).alias("h"))


@query("clean_lines", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '[ \t]+', ' ', 'g'),
 '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS h FROM documents""")
def _(t: Tables):
    return t.documents.select("doc_id", md5(X.clean_lines("text")).alias("h"))


OCR = r"""SELECT doc_id, md5(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace({0}, '\r\n|\r', chr(10), 'g'), '[ \t]+', ' ', 'g'),
 '\n{{3,}}', chr(10) || chr(10), 'g'), '~', ''), '|', 'I'), '^\s+|\s+$', '', 'g')) AS h FROM documents"""
BROKEN = r"regexp_replace(text, '(\w)-\s*\n\s*(\w)', '\1\2', 'g')"


@query("clean_ocr", OCR.format(r"regexp_replace(" + BROKEN + r", '(\w)-(\w{2,})', '\1\2', 'g')"))
def _(t: Tables):
    return t.documents.select("doc_id", md5(X.clean_ocr("text")).alias("h"))


@query("clean_ocr_broken_lines_only", OCR.format(BROKEN))
def _(t: Tables):
    return t.documents.select("doc_id", md5(X.clean_ocr("text", legacy=False)).alias("h"))


@query("repair_double_encoded_text", "SELECT doc_id, md5(text) AS h FROM documents")
def _(t: Tables):
    # each text is damaged the way archives damage it, then repaired back to the original
    damaged = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return t.documents.select("doc_id", md5(X.repair_mojibake(damaged)).alias("h"))


@query("usable_text", r"SELECT doc_id FROM documents WHERE length(text) >= 60 AND len(regexp_extract_all(text, '[^\x20-\x7E]')) / greatest(length(text), 1) < 0.05")
def _(t: Tables):
    return t.documents.filter(X.usable_text("text")).select("doc_id")


@query("plausible_first_line", r"""SELECT doc_id FROM (SELECT doc_id, string_split(text, chr(10))[1] AS l FROM documents) WHERE length(l) >= 8
 AND NOT regexp_matches(ltrim(l), '^[(~\-\[]') AND len(regexp_extract_all(l, '[A-Za-z]{2,}')) >= 2 AND NOT regexp_full_match(l, '(?i)\(?\s*Reaffirmed[^)]*\)?')""")
def _(t: Tables):
    return t.documents.filter(X.plausible_title(F.split("text", "\n")[0])).select("doc_id")


@query("exclude_titles", r"SELECT page_id FROM pages WHERE NOT regexp_matches(html, '(?i)glossary of terms|vocabulary|\bcode of ethics|guidelines for the preparation')")
def _(t: Tables):
    return t.pages.filter(~F.col("html").rlike(V.EXCLUDED_TITLE)).select("page_id")


ACR = ",".join(f"'{w}'" for w in V.ACRONYMS)
LOWW = ",".join(f"'{w}'" for w in V.LOWERCASE_WORDS)


@query("smart_title_case", rf"""SELECT p_partkey AS id, CASE WHEN k = upper(k) THEN array_to_string(list_transform(string_split(k, ' '), lambda w, i: CASE
 WHEN upper(regexp_replace(w, '[^A-Za-z]', '', 'g')) IN ({ACR}) THEN upper(w) WHEN i > 1 AND lower(regexp_replace(w, '[^A-Za-z]', '', 'g')) IN ({LOWW}) THEN lower(w)
 ELSE upper(w[1:1]) || lower(w[2:]) END), ' ') ELSE k END AS title FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name || ' for pvc and led of ' || p_type)
 ELSE p_name || ' for PVC' END AS k FROM part)""")
def _(t: Tables):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.upper(F.concat("p_name", F.lit(" for pvc and led of "), "p_type"))).otherwise(F.concat("p_name", F.lit(" for PVC")))
    return t.part.select(F.col("p_partkey").alias("id"), X.smart_title(raw).alias("title"))


@query("strip_title_year", r"SELECT p_partkey AS id, p_name AS a, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' x' ELSE p_name END AS b FROM part")
def _(t: Tables):
    dated = F.concat(F.col("p_size") + 1960, F.lit(" : "), "p_name")
    listed = F.concat(F.lit("IS "), F.col("p_partkey") + 100, F.lit(".1: "), "p_name",
                      F.when(F.col("p_partkey") % 3 == 0, "  (Bi-Lingual)  x").otherwise("( BiLingual )"))
    return t.part.select(F.col("p_partkey").alias("id"), X.clean_title(dated).alias("a"), X.archive_title(listed).alias("b"))


@query("tidy_scope", r"""SELECT doc_id, md5(trim(regexp_replace(string_split_regex(string_split_regex('1.1 ' || replace(left_text, chr(10), ' ') || ' 2 REFERENCES 2.1 other', '(?i)\s+\d+\s+(?:REFERENCES?|TERMINOLOGY|DEFINITIONS?|NORMATIVE|GENERAL|REQUIREMENTS?)\b')[1],
 '\s+[*f†]\s*[A-Z]')[1], '^[.\s]*\d+(\.\d+)*\s*', ''))) AS h FROM (SELECT doc_id, text AS left_text FROM documents)""")
def _(t: Tables):
    scope = F.concat(F.lit("1.1 "), F.translate("text", "\n", " "), F.lit(" 2 REFERENCES 2.1 other"))
    return t.documents.select("doc_id", md5(X.tidy_scope(scope)).alias("h"))


SECTOR_SQL = "CASE " + " ".join(f"WHEN regexp_matches(k, '(?i){p}') THEN '{n}'" for n, p in V.SECTOR_RULES) + " END"


@query("classify_sector", f"SELECT id, {SECTOR_SQL} AS sector FROM (SELECT p_partkey AS id, lower(p_name || ' ' || CASE p_partkey % 9 WHEN 0 THEN 'PVC hose' WHEN 1 THEN 'drinking water' WHEN 2 THEN 'method of test' WHEN 3 THEN 'soil' ELSE p_type END) AS k FROM part)")
def _(t: Tables):
    k = F.col("p_partkey") % 9
    extra = F.when(k == 0, "PVC hose").when(k == 1, "drinking water").when(k == 2, "method of test").when(k == 3, "soil").otherwise(F.col("p_type"))
    return t.part.select(F.col("p_partkey").alias("id"), X.classify(F.concat("p_name", F.lit(" "), extra)).alias("sector"))


KW = ",".join(f"'{w}'" for w in V.KEYWORD_STOP)


@query("salient_keywords", f"""SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(k), lambda w: printf('%06d', list_position(k, w)) || w))[1:10], lambda s: s[7:]), ' ') AS kws FROM (
 SELECT doc_id, list_filter(regexp_extract_all(lower(source || ' ' || text[1:300]), '[a-z][a-z-]{{3,}}'), lambda w: w NOT IN ({KW})) AS k FROM documents)""")
def _(t: Tables):
    return t.documents.select("doc_id", F.array_join(X.keywords("source", "text"), " ").alias("kws"))


EDGEW = "|".join(V.QUERY_EDGE_WORDS)


@query("query_text_from_title", rf"""SELECT doc_id, CASE WHEN length(k) >= 8 AND len(string_split(k, ' ')) >= 2 THEN k ELSE '' END AS q FROM (
 SELECT doc_id, trim(regexp_replace(regexp_replace(lower(array_to_string(string_split(trim(regexp_replace(regexp_replace(regexp_replace('Specification for ' || string_split(text, chr(10))[1] || ' of', '{V.TITLE_NOISE}', ' ', 'g'),
 '[-—:,()]+', ' ', 'g'), '\s+', ' ', 'g')), ' ')[1:9], ' ')), '^(?:(?:{EDGEW})(?: |$))+', ''), '(?:(?:^| )(?:{EDGEW}))+$', '')) AS k FROM documents)""")
def _(t: Tables):
    title = F.concat(F.lit("Specification for "), F.split("text", "\n")[0], F.lit(" of"))
    return t.documents.select("doc_id", X.query_from_title(title, "doc_id", templates=["{}"]).alias("q"))


@query("query_text_with_template")
def _(t: Tables):
    return t.part.select(F.col("p_partkey").alias("id"), X.query_from_title(F.concat("p_name", F.lit(" "), "p_type"), "p_partkey").alias("q"))


@query("detect_script", "SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'hi' WHEN 2 THEN 'bn' WHEN 3 THEN 'ta' WHEN 4 THEN 'te' ELSE 'en' END AS script FROM documents")
def _(t: Tables):
    k = F.col("doc_id") % 5
    word = F.when(k == 1, "पानी ").when(k == 2, "জল ").when(k == 3, "நீர் ").when(k == 4, "నీరు ").otherwise("")
    return t.documents.select("doc_id", X.detect_script(F.concat(word, "text")).alias("script"))


@query("latin_share", r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]')) >= greatest(3.0, 0.5 * len(regexp_extract_all(text, '[\p{L}\p{N}_]'))) AS latin FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", X.is_latin("text").alias("latin"))


@query("content_hash", """SELECT doc_id, sha256(to_json({doc_id: doc_id, lang: lang, text: text})::VARCHAR)[1:16] AS h FROM documents""")
def _(t: Tables):
    return t.documents.select("doc_id", X.content_hash("text", "lang", "doc_id").alias("h"))


@query("recency_score", """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 0.5 ELSE round(greatest(0, 1 - greatest(0, 2000 - year(o_orderdate)) / 10.0), 6) END AS recency FROM orders""")
def _(t: Tables):
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, "n/a").when(k == 1, F.date_format("o_orderdate", "yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select(F.col("o_orderkey").alias("id"), F.round(S.recency(text, 2000), 6).alias("recency"))


LEX = {"bolts": ["bolt", "ring", "hot"], "rods": ["rod", "red", "gear", "hot"], "plates": ["plate", "blue"]}


@query("category_match", """WITH k AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS w, CASE p_partkey % 4 WHEN 0 THEN 'bolts' WHEN 1 THEN 'rods' WHEN 2 THEN 'plates' ELSE 'other' END AS c FROM part),
 n AS (SELECT *, len(list_intersect(w, ['bolt','ring','hot'])) AS a, len(list_intersect(w, ['rod','red','gear','hot'])) AS b, len(list_intersect(w, ['plate','blue'])) AS p FROM k),
 m AS (SELECT *, CASE c WHEN 'bolts' THEN a WHEN 'rods' THEN b ELSE p END AS own, CASE c WHEN 'bolts' THEN greatest(b, p) WHEN 'rods' THEN greatest(a, p) ELSE greatest(a, b) END AS oth FROM n)
 SELECT id, CASE WHEN c = 'other' THEN 0.5 WHEN own = 0 THEN 0.2 ELSE round(least(1.0, 0.3 + 0.7 * own / (own + oth + 1e-6)), 6) END AS score FROM m""")
def _(t: Tables):
    k = F.col("p_partkey") % 4
    cat = F.when(k == 0, "bolts").when(k == 1, "rods").when(k == 2, "plates").otherwise("other")
    return t.part.select(F.col("p_partkey").alias("id"), F.round(S.category_match("p_name", cat, LEX), 6).alias("score"))


@query("keyword_overlap", """WITH q AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_type) AS q, [string_split(p_name, ' ')[1], 'extra ' || p_type || ' ' || string_split(p_name, ' ')[2], 'cold', lower(p_type)] AS ks FROM part)
 SELECT id, round(least(1.0, list_sum(list_transform(ks, lambda k: CASE WHEN contains(q, lower(k)) THEN 1.0 WHEN len(string_split(lower(k), ' ')) > 1
 AND len(list_filter(string_split(lower(k), ' '), lambda w: length(w) > 2 AND contains(q, w))) >= 0.6 * len(string_split(lower(k), ' ')) THEN 0.5 ELSE 0 END)) / len(ks)), 6) AS overlap FROM q""")
def _(t: Tables):
    ws = F.split("p_name", " ")
    ks = F.array(ws[0], F.concat(F.lit("extra "), "p_type", F.lit(" "), ws[1]), F.lit("cold"), F.lower("p_type"))
    q = F.concat("p_name", F.lit(" "), "p_type")
    return t.part.select(F.col("p_partkey").alias("id"), F.round(S.keyword_overlap(q, ks), 6).alias("overlap"))


@query("fallback_score", "SELECT l_orderkey AS o, l_linenumber AS l, l_partkey AS p, round(0.3 * l_discount + 0.2 * l_tax + 0.5 * (l_quantity - 10), 6) AS s FROM lineitem")
def _(t: Tables):
    s = S.fallback_score(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") - 10)
    return t.lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_partkey").alias("p"), F.round(s, 6).alias("s"))


@query("confidence_band", """SELECT s_suppkey AS id, CASE WHEN d = 'low' AND b = 'high' THEN 'medium' WHEN d = 'low' THEN 'low' WHEN d = 'medium' AND b = 'high' THEN 'medium' ELSE b END AS band FROM (
 SELECT s_suppkey, CASE WHEN x >= 0.55 THEN 'high' WHEN x >= 0.35 THEN 'medium' ELSE 'low' END AS b, d FROM (SELECT s_suppkey, s_acctbal / 10000 AS x,
 CASE s_suppkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'high' END AS d FROM supplier))""")
def _(t: Tables):
    k = F.col("s_suppkey") % 4
    trust = F.when(k == 0, "low").when(k == 1, "medium").when(k == 2, "high")
    return t.supplier.select(F.col("s_suppkey").alias("id"), S.confidence_band(F.col("s_acctbal") / 10000, trust).alias("band"))


@query("marking_phrase", W.cte(W.DRAFT) + "SELECT doc, regexp_matches(lower(text), 'isi mark|isi-marked|standard mark|bis mark|bis certifi|bis licen[cs]e|crs registration|crs registered|hallmark|huid|bis registration|r-number') AS marked FROM draft")
def _(t: Tables):
    return W.drafts(t).select("doc", X.has_marking("text").alias("marked"))


@query("evidence_wording_guard", r"""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' ELSE array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text || ' Bidder shall furnish a test report. Licence Number and CM/L, shall furnish'),
 '\blicen[cs]e\s+number\b|\bcm/l\b|\btest\s+report\b|\bcertificate\s+number\b|\brequired\s+evidence\b|\bevidence\s+required\b|\bmust\s+(?:submit|provide|furnish)\b|\bshall\s+(?:submit|provide|furnish)\b'))), '; ') END AS terms FROM conversations""")
def _(t: Tables):
    text = F.concat("text", F.lit(" Bidder shall furnish a test report. Licence Number and CM/L, shall furnish"))
    return t.conversations.select("conv_id", "turn", F.array_join(X.evidence_terms(text, F.col("turn") % 3 == 0), "; ").alias("terms"))


@query("verification_reason", """SELECT o_orderkey AS id, ck IS NOT NULL AND d <= 365 AS verified, CASE WHEN ck IS NOT NULL AND d <= 365 THEN NULL WHEN ck IS NOT NULL THEN 'stale_check'
 WHEN url THEN 'unchecked_source' ELSE 'no_provenance' END AS reason FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END AS ck, o_orderkey % 2 = 0 AS url,
 date_diff('day', o_orderdate::DATE, DATE '1998-08-01') AS d FROM orders)""")
def _(t: Tables):
    at = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate"))
    url = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority"))
    v = S.verification(url, at, F.lit("1998-08-01").cast("date"))
    return t.orders.select(F.col("o_orderkey").alias("id"), v["verified"].alias("verified"), v["reason"].alias("reason"))


@query("number_spelling", """SELECT id, concat('IS ', n, ' (Part ', p, '):', y) AS colon, concat('IS ', n, ' (PART ', p, '):', y) AS up, concat('IS ', n, ':', y) AS sep
 FROM (SELECT p_partkey AS id, 100 + p_partkey % 900 AS n, 1 + p_partkey % 7 AS p, 1960 + p_size AS y FROM part)""")
def _(t: Tables):
    n, p, y = F.col("p_partkey") % 900 + 100, F.col("p_partkey") % 7 + 1, F.col("p_size") + 1960
    k = F.col("p_partkey") % 4
    loose = F.concat(F.lit("  IS   "), n, F.when(k == 0, " ( part  ").when(k == 1, " (PART ").otherwise(" (Part "), p, F.lit("  ) : "), y)
    sep = F.concat(F.lit("is"), F.when(k == 0, "  ").when(k == 1, " ").otherwise(""), n, F.when(k == 0, "/").when(k == 1, "-").otherwise(": "), y, F.lit("  "))
    return t.part.select(F.col("p_partkey").alias("id"), N.normalize_number(loose).alias("colon"),
                         N.normalize_number(loose, "upper").alias("up"), N.normalize_number(sep, "sep").alias("sep"))


@query("number_canonical", """SELECT id, CASE k WHEN 0 THEN concat('IS ', n, '-', p, ':', y) WHEN 1 THEN concat('IS ', n, '-', p, '-', s, ':', y) WHEN 2 THEN concat('IS ', n, ':', y)
 WHEN 3 THEN concat('IS ', n, '-', p, '-', s, ':', y) WHEN 4 THEN concat('IS ', n) ELSE NULL END AS canonical
 FROM (SELECT p_partkey AS id, p_partkey % 6 AS k, 100 + p_partkey % 9000 AS n, 1 + p_partkey % 7 AS p, 1 + p_partkey % 3 AS s, 1960 + p_size AS y FROM part)""")
def _(t: Tables):
    n, p, s, y = F.col("p_partkey") % 9000 + 100, F.col("p_partkey") % 7 + 1, F.col("p_partkey") % 3 + 1, F.col("p_size") + 1960
    k = F.col("p_partkey") % 6
    raw = (F.when(k == 0, F.concat(F.lit("as per is:"), n, F.lit(" (Part "), p, F.lit(") : "), y))
           .when(k == 1, F.concat(F.lit("I.S. "), n, F.lit(" Pt."), p, F.lit("/Sec "), s, F.lit(" -"), y, F.lit(" 77 88")))
           .when(k == 2, F.concat(F.lit("IS-"), n, F.lit(" "), y))
           .when(k == 3, F.concat(F.lit("IS "), n, F.lit(" "), y, F.lit(" "), p, F.lit(" "), s))
           .when(k == 4, F.concat(F.lit("IS "), n)).otherwise(F.concat(F.lit("ISO "), n)))
    return t.part.select(F.col("p_partkey").alias("id"), N.canonical_number(raw).alias("canonical"))


@query("number_fields", """SELECT id, n::VARCHAR AS base, CASE WHEN k < 3 THEN p::VARCHAR END AS part, CASE WHEN k = 0 THEN s::VARCHAR END AS section,
 CASE WHEN k = 2 THEN concat(n, '||') WHEN k = 1 THEN concat(n, '|', p, '|') WHEN k = 0 THEN concat(n, '|', p, '|', s) ELSE concat(n, '||') END AS family, concat('IS', CASE WHEN k = 2 THEN '/IEC' ELSE '' END, ' ', n, CASE k WHEN 0 THEN concat(' (PART ', p, '/SEC ', s, ')') WHEN 1 THEN concat(' (PART ', p, ')') WHEN 2 THEN concat('-', p) ELSE '' END) AS prefix
 FROM (SELECT p_partkey AS id, p_partkey % 4 AS k, 100 + p_partkey % 9000 AS n, 1 + p_partkey % 7 AS p, 1 + p_partkey % 3 AS s, 1960 + p_size AS y FROM part)""")
def _(t: Tables):
    n, p, s, y = F.col("p_partkey") % 9000 + 100, F.col("p_partkey") % 7 + 1, F.col("p_partkey") % 3 + 1, F.col("p_size") + 1960
    k = F.col("p_partkey") % 4
    raw = (F.when(k == 0, F.concat(F.lit("IS "), n, F.lit(" (Part "), p, F.lit("/Sec "), s, F.lit(")")))
           .when(k == 1, F.concat(F.lit("IS "), n, F.lit("  (Part "), p, F.lit("):"), y))
           .when(k == 2, F.concat(F.lit("IS/IEC "), n, F.lit("-"), p)).otherwise(F.concat(F.lit("IS "), n, F.lit(":"), y)))
    f = N.parse_number(raw)
    return t.part.select(F.col("p_partkey").alias("id"), f["base"].alias("base"), f["part"].alias("part"), f["section"].alias("section"),
                         N.family_key(raw).alias("family"), N.family_key(raw, "prefix").alias("prefix"))


@query("citations_with_spans", W.cte(W.DRAFT, W.CITE) + 'SELECT doc, pos, raw, base, part, year, "start", "end" FROM cite')
def _(t: Tables):
    return N.extract_citations(W.drafts(t), "doc", "text").select("doc", "pos", "raw", "base", "part", "year", "start", "end")


@query("line_items_with_spans", r"""WITH l AS (SELECT conv_id, turn, text, string_split(text, chr(10)) AS ls FROM conversations),
 x AS (SELECT conv_id, turn, unnest(range(1, len(ls) + 1)) AS i, ls FROM l),
 y AS (SELECT conv_id, turn, i - 1 AS line, ls[i] AS raw, coalesce(list_sum(list_transform(ls[1:i-1], lambda s: length(s) + 1)), 0) AS off FROM x),
 z AS (SELECT *, trim(regexp_replace(trim(raw), '^\s*(?:[-*•]|\(?[a-zA-Z0-9]{1,3}[\).:]|\d+\.)\s*', '')) AS item FROM y)
 SELECT conv_id, turn, line, item, (off + instr(raw, item) - 1)::BIGINT AS "start", (off + instr(raw, item) - 1 + length(item))::BIGINT AS "end" FROM z WHERE length(item) >= 4""")
def _(t: Tables):
    c = t.conversations.withColumn("k", F.struct("conv_id", "turn"))
    return N.line_items(c, "k", "text").select("k.conv_id", "k.turn", "line", "item", "start", "end")


@query("archive_item_ids", """SELECT id, CASE k WHEN 3 THEN NULL ELSE n::VARCHAR END AS number, CASE WHEN k IN (1, 2) THEN p::VARCHAR END AS part, CASE WHEN k = 2 THEN s::VARCHAR END AS section,
 CASE WHEN k <> 3 THEN y END AS year, CASE k WHEN 0 THEN concat('IS_', n, '_', y) WHEN 1 THEN concat('IS_', n, '_', p, '_', y) WHEN 2 THEN concat('IS_', n, '_', p, '_', s, '_', y) ELSE 'IS' END AS made
 FROM (SELECT p_partkey AS id, p_partkey % 4 AS k, 100 + p_partkey % 9000 AS n, 1 + p_partkey % 7 AS p, 1 + p_partkey % 3 AS s, 1960 + p_size AS y FROM part)""")
def _(t: Tables):
    n, p, s, y = F.col("p_partkey") % 9000 + 100, F.col("p_partkey") % 7 + 1, F.col("p_partkey") % 3 + 1, F.col("p_size") + 1960
    k = F.col("p_partkey") % 4
    raw = (F.when(k == 0, N.item_id(n, F.lit(None), F.lit(None), y)).when(k == 1, N.item_id(n, p, F.lit(None), y))
           .when(k == 2, F.upper(N.item_id(n, p, s, y))).otherwise(F.concat(F.lit("gov.in.is."), n, F.lit(".17"))))
    f = N.item_id_fields(raw)
    return t.part.select(F.col("p_partkey").alias("id"), *[f[c].alias(c) for c in ("number", "part", "section", "year")],
                         N.make_id(f["number"], f["part"], f["section"], f["year"]).alias("made"))


@query("index_text_variants", """SELECT p_partkey AS id, concat(p_name, ' ', p_type, '. ', p_brand) AS plain, concat(p_name, ' ', p_type, '. ', p_brand, CASE WHEN p_partkey % 2 = 0 THEN ' Also known as: ' || lower(p_type) || ', ' || p_brand || '.' ELSE '' END) AS aliased,
 concat_ws('. ', p_name, p_type, CASE WHEN p_partkey % 2 = 0 THEN 'Also known as: ' || lower(p_type) || ', ' || p_brand END) AS pair FROM part""")
def _(t: Tables):
    from specloom.operators.corpus import index_text
    s = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("number"), F.col("p_type").alias("title"), F.col("p_brand").alias("scope"),
                      F.when(F.col("p_partkey") % 2 == 0, F.array(F.lower("p_type"), "p_brand")).otherwise(F.array().cast("array<string>")).alias("aliases"))
    return s.select("id", index_text("plain").alias("plain"), index_text("aliased").alias("aliased"),
                    index_text("pair", scope=None).alias("pair"))


@query("relation_names", """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'NORMATIVE_REFERENCE' WHEN 1 THEN 'AMENDED_BY' WHEN 2 THEN 'TEST_METHOD' END AS rel FROM part""")
def _(t: Tables):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, " normative reference ").when(k == 1, "Amended-By").when(k == 2, "test_method").otherwise(F.col("p_type"))
    return t.part.select(F.col("p_partkey").alias("id"), N.normalize_relation(raw).alias("rel"))


@query("json_properties", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(t: Tables):
    return t.events.select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query("citation_text", """SELECT p_partkey AS id, concat('IS ', p_partkey, ':', 1960 + p_size, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat(', incorporating Amendment No. 2 (', 2000 + p_size, ')') ELSE ', incorporating Amendment No. 1 (n.d.)' END) AS cite,
 concat('IS ', p_partkey, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN ', incorporating Amendment No. 1 (May 2013)' WHEN 2 THEN ', incorporating all 3 amendments, latest (Amendment No. 3, May 2013)' WHEN 3 THEN ', incorporating all 2 published amendments' ELSE '' END) AS counted,
 CASE WHEN p_size % 12 > 0 THEN concat(strftime(make_date(2000, (p_size % 12)::INT, 1), '%B'), ' 2001') ELSE '2001' END AS month FROM part""")
def _(t: Tables):
    k, m = F.col("p_partkey") % 3, F.col("p_partkey") % 5
    one = F.array(F.struct(F.lit(1).alias("no"), F.lit(None).cast("string").alias("date")))
    two = F.array(F.struct(F.lit(2).alias("no"), (F.col("p_size") + 2000).cast("string").alias("date")),
                  F.struct(F.lit(1).alias("no"), F.lit("1999").alias("date")))
    ams = F.when(k == 1, two).when(k == 2, one)
    num = F.concat(F.lit("IS "), "p_partkey")
    count = F.when(m == 0, 0).when(m == 1, 1).when(m == 2, 3).when(m == 3, 2)
    last = F.when(m == 1, 1).when(m == 2, 3)
    month = F.when(F.col("p_size") % 12 > 0, F.concat(F.lit("2001-"), F.lpad((F.col("p_size") % 12).cast("string"), 2, "0"))).otherwise("2001")
    return t.part.select(F.col("p_partkey").alias("id"), N.format_citation(num, F.col("p_size") + 1960, ams).alias("cite"),
                         N.counted_citation(num, count, last, X.readable_month(F.lit("2013-05"))).alias("counted"), X.readable_month(month).alias("month"))


TENDER = "concat('NOTICE', chr(10), CASE conv_id % 3 WHEN 0 THEN 'Scope of Supply for ' WHEN 1 THEN 'Technical  Specification ' ELSE 'General ' END, role, chr(10), text, chr(10), CASE turn % 3 WHEN 0 THEN 'Item 1: bolts of 12 mm' || chr(10) || chr(10) || 'earnest money 5 mm' WHEN 1 THEN chr(10) || '3 kg of rods' || chr(10) ELSE '' END, chr(10), '2. Annexure', chr(10), 'tail')"


def tender(t: Tables):
    k, m = F.col("conv_id") % 3, F.col("turn") % 3
    head = F.when(k == 0, "Scope of Supply for ").when(k == 1, "Technical  Specification ").otherwise("General ")
    mid = F.when(m == 0, "Item 1: bolts of 12 mm\n\nearnest money 5 mm").when(m == 1, "\n3 kg of rods\n").otherwise("")
    return t.conversations.select("conv_id", "turn", F.concat(F.lit("NOTICE\n"), head, "role", F.lit("\n"), "text", F.lit("\n"), mid, F.lit("\n2. Annexure\ntail")).alias("text"))


SECTION = rf"""t AS (SELECT conv_id, turn, {TENDER} AS text FROM conversations),
 p AS (SELECT *, CASE WHEN regexp_matches(lower(text), 'technical\s+specification') THEN length(string_split_regex(lower(text), 'technical\s+specification')[1]) + 1
  WHEN regexp_matches(lower(text), 'scope\s+of\s+(?:work|supply)') THEN length(string_split_regex(lower(text), 'scope\s+of\s+(?:work|supply)')[1]) + 1 END AS st FROM t),
 s AS (SELECT *, trim(string_split(substr(text, st, 80), chr(10))[1]) AS heading, substr(text, st, 200) || string_split_regex(substr(substr(text, st, 4000), 201), '\n\s*(?:\d+\.\s+[A-Z]|[A-Z][A-Z\s]{{12,}}\n)')[1] AS section FROM p)"""


@query("specification_section", W.cte(SECTION) + "SELECT conv_id, turn, heading, md5(section) AS h FROM s")
def _(t: Tables):
    s = X.spec_section("text")
    return tender(t).select("conv_id", "turn", s["heading"].alias("heading"), md5(s["section"]).alias("h"))


@query("relevant_units", W.cte(SECTION, rf"""u AS (SELECT conv_id, turn, coalesce(section, text) AS src, list_filter(list_transform(string_split_regex(array_to_string(list_transform(string_split(coalesce(section, text), chr(10)),
 lambda x: trim(regexp_replace(x, '\s', ' ', 'g'))), chr(10)), '\n{{2,}}'), lambda x: trim(replace(x, chr(10), ' '))), lambda x: x <> '') AS units FROM s),
 f AS (SELECT *, list_filter(units, lambda x: NOT regexp_matches(x, '{V.UNIT_BOILERPLATE}')) AS plain FROM u),
 g AS (SELECT *, list_filter(plain, lambda x: length(x) > 12 AND (regexp_matches(x, '{V.TECHNICAL_HINT}') OR regexp_matches(x, '{V.LINE_ITEM_PATTERN}'))) AS tech, list_filter(plain, lambda x: length(x) > 25) AS prose FROM f)""") + """
 SELECT conv_id, turn, len(k) AS n, md5(array_to_string(k, chr(10))) AS h FROM (SELECT conv_id, turn, CASE WHEN len(tech) > 0 THEN tech WHEN len(prose) > 0 THEN prose ELSE [src] END AS k FROM g)""")
def _(t: Tables):
    u = X.spec_units("text")
    return tender(t).select("conv_id", "turn", F.size(u).cast("bigint").alias("n"), md5(F.array_join(u, "\n")).alias("h"))
