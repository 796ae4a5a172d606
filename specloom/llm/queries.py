"""The registered queries of the training-data operators: each applies its operator to the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm import ann, chat, decontam, hmm, langid, lexical, licenses, merkle, mixing, pii, simhash, tokens, warc
from specloom.llm.common import read_table


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: n_tokens, domain (the likeliest), a posterior for each domain, rate."""
    labels = read_table(spark, folder, "labels").select("doc_id", mixing.domain_of_labels().alias("domain"))
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    mixed, domains = mixing.mix(docs, labels, with_text=False)
    best = F.array_position("posteriors", F.array_max("posteriors"))
    names = F.array(*[F.lit(d) for d in domains])
    shares = [F.get("posteriors", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(domains)]
    return mixed.select("doc_id", "n_tokens", F.element_at(names, best.cast("int")).alias("domain"), *shares, "rate")


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify_languages(read_table(spark, folder, "documents").select("doc_id", "text", "lang"))


def op3_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: doc_id, text with surrogates, n_entities, kinds."""
    return pii.replace_pii(read_table(spark, folder, "documents").select("doc_id", "text"), PII_KEY)


#: The key of the surrogates. Whoever has it can tell which surrogate stands for a guessed entity; give your own.
PII_KEY = b"specloom surrogates, replace me"


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds: doc_id, item_id, n_tiles, longest, coverage."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return decontam.find_leaks(docs, read_table(spark, folder, "benchmark")).drop("key")


def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    text = "\\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.formatted_digests(chat.format_conversations(rows.unionByName(planted)))


#: The template's length: "### ", ":\n", "\n</turn>\n" and the escapes of role and text.
OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'), ':', '\:'))
    + length(replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>')) + 15 AS n FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op6_token_output(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_output(read_table(spark, folder, "documents").select("doc_id", "text"))


def op7_hmm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return hmm.hmm_scores(read_table(spark, folder, "documents").select("doc_id", "text"))


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_groups(read_table(spark, folder, "documents").select("doc_id", "text"))


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, folder, "documents").select("doc_id", "text")).drop("spans")


def op10_graph_search(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(read_table(spark, folder, "embeddings").select("vec_id", "embedding"))


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return lexical.rank_documents(docs, read_table(spark, folder, "benchmark").select("item_id", "text"))


OP11_SQL = r"""
WITH terms AS (
  SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)),
asked AS (
  SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)),
q AS (SELECT item, item_id, term, count(*) AS c FROM asked GROUP BY ALL),
tf AS (SELECT row, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT row, count(*) AS n FROM terms GROUP BY row),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM sizes),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, totals),
m AS (SELECT row, 25 + (75 * n * docs) // len AS m FROM sizes, totals),
scored AS (
  SELECT item, item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (row) GROUP BY item, item_id, row, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return merkle.verified_manifest(docs, claimed=merkle.changed_leaf(merkle.FIELDS))


OP12_SQL = """
WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
rows AS (
  SELECT row_number() OVER () AS id, *,
    doc_id IS NOT NULL AND xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AS hit FROM documents, bits),
framed AS (
  SELECT id, doc_id, lang, hit, n_chars,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(text) || ':' || text, '-') AS z FROM rows),
leaves AS (
  SELECT id, doc_id, lang, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || z) AS leaf,
    sha256(a || coalesce(strlen((n_chars + hit::BIGINT)::VARCHAR) || ':' || (n_chars + hit::BIGINT), '-') || z) AS claimed FROM framed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (
  SELECT 0 AS level, lang, i, n, leaf AS digest FROM ranked
  UNION ALL SELECT level + 1, lang, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY level, lang, i // 2, n),
subroots AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
uppers AS (
  SELECT 0 AS level, i, n, subroot AS digest FROM subroots
  UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM uppers WHERE n > 1 GROUP BY level, i // 2, n),
way AS (
  SELECT id, lang, 0 AS level, i, n, claimed AS digest, '' AS proof FROM ranked
  UNION ALL SELECT w.id, w.lang, w.level + 1, w.i // 2, (w.n + 1) // 2,
    sha256(CASE WHEN w.i % 2 = 0 THEN w.digest || coalesce(s.digest, '') ELSE s.digest || w.digest END), w.proof || coalesce(s.digest, '')
  FROM way w LEFT JOIN nodes s ON s.level = w.level AND s.lang IS NOT DISTINCT FROM w.lang AND s.i = xor(w.i, 1) WHERE w.n > 1),
last_way AS (
  SELECT w.id, w.lang, 0 AS level, s.i, s.n, w.digest, w.proof FROM way w JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL SELECT w.id, w.lang, w.level + 1, w.i // 2, (w.n + 1) // 2,
    sha256(CASE WHEN w.i % 2 = 0 THEN w.digest || coalesce(s.digest, '') ELSE s.digest || w.digest END), w.proof || coalesce(s.digest, '')
  FROM last_way w LEFT JOIN uppers s ON s.level = w.level AND s.i = xor(w.i, 1) WHERE w.n > 1)
SELECT r.doc_id, r.leaf, s.subroot, u.digest AS root, sha256(w.proof) AS proof_sha256, w.digest AS folded_root, w.digest = u.digest AS verified
FROM ranked r JOIN last_way w ON w.id = r.id AND w.n = 1 JOIN subroots s ON s.lang IS NOT DISTINCT FROM r.lang CROSS JOIN (SELECT digest FROM uppers WHERE n = 1) u
"""


def op13_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(read_table(spark, folder, "pages").select("page_id", "url", "html"))


OP13_SQL = """
WITH rows AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
hashed AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex FROM rows),
named AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda g:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, (5 * (g // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (g % 4))::BIGINT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest FROM hashed),
kept AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS keep FROM named)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keep THEN keep END AS refers_to FROM kept
"""


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_language_id, op3_pii_surrogates, op4_decontamination, op5_chat_format, op6_token_output, op7_hmm_scoring, op8_simhash, op9_license_scan, op10_graph_search, op11_lexical_search, op12_merkle_manifest, op13_warc)}

#: The others train models, hash with XXH64, search approximately or write files, which SQL can't express; tests hold
#: them against brute force.
LLM_ORACLE: dict[str, str] = {"op5_chat_format": OP5_SQL, "op11_lexical_search": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_warc": OP13_SQL}
