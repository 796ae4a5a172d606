"""Corpus building: consolidation, merging, supersession, validation, change detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.functions import extract as E
from specloom.functions import numbers as N
from specloom.functions import text as X
from specloom.functions import vocab as V
from specloom.functions.text import content_hash
from specloom.operators.ranking import exact_rank


def index_text(variant: str, scope: str | None = "scope") -> Column:
    """Text to index or to pair with a query, from number, title, scope and aliases.

    ``plain``: number, title and scope; ``aliased`` adds the aliases; ``pair`` joins the parts that
    are present and names at most eight aliases.
    """
    some = F.size("aliases") > 0
    if variant == "pair":
        parts = [F.nullif(F.col(c), F.lit("")) for c in ("number", "title", scope) if c]
        names = F.when(some, F.concat(F.lit("Also known as: "), F.array_join(F.slice("aliases", 1, 8), ", ")))
        return F.concat_ws(". ", *parts, names)
    base = F.concat("number", F.lit(" "), "title", F.lit(". "), "scope")
    if variant == "plain":
        return base
    names = F.concat(F.lit(" Also known as: "), F.array_join("aliases", ", "), F.lit("."))
    return F.concat(base, F.when(some, names).otherwise(F.lit("")))


# ---- union, ids, vocabulary ------------------------------------------------------------------

def union_sources(sources: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """Union of differently shaped sources, each row tagged with where it came from."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def assign_ids(df: DataFrame, sector: str, order: list[str], prefix: Column, width: int, out: str = "id") -> DataFrame:
    """Zero-padded running ids inside each sector, in the given (unique) order."""
    ranked = exact_rank(df, [sector], order, "_n")
    return ranked.withColumn(out, F.concat(F.lit("IS-"), prefix, F.lit("-"), F.lpad(F.col("_n").cast("string"), width, "0"))).drop("_n")


def map_vocab(df: DataFrame, col: str, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Translate a column through ``mapping(value, canonical)``; unmapped rows are returned as rejects."""
    key = F.lower(F.trim(F.col(col)))
    joined = df.withColumn("_v", key).join(mapping.select(F.col("value").alias("_v"), "canonical"), "_v", "left").drop("_v")
    good = joined.filter(F.col("canonical").isNotNull()).withColumn(col, F.col("canonical")).drop("canonical")
    return good, joined.filter(F.col("canonical").isNull()).drop("canonical")


def conform(df: DataFrame, schema: dict[str, str], renames: dict[str, str] | None = None,
            defaults: dict[str, Column] | None = None) -> DataFrame:
    """Select exactly the schema's columns: renamed, defaulted where missing or NULL, and cast."""
    renames, defaults = renames or {}, defaults or {}
    back = {new: old for old, new in renames.items()}
    out = []
    for name, kind in schema.items():
        source = back.get(name, name)
        value = F.col(source) if source in df.columns else F.lit(None)
        if name in defaults:
            value = F.coalesce(value, defaults[name])
        out.append(value.cast(kind).alias(name))
    return df.select(*out)


# ---- consolidation ---------------------------------------------------------------------------

def consolidate(records: DataFrame, categories: DataFrame, width: int = 3) -> tuple[DataFrame, DataFrame]:
    """One record per normalised number, as (corpus, rejects with an unmapped category).

    ``records(source, ordinal, number, title, scope, description, category, status, keywords)``;
    ``categories(value, canonical, prefix)``. The richest text wins, the earliest on a tie. The
    winner keeps its keywords and gains those of records that arrived after it.
    """
    keyed = records.withColumn("number", N.normalize_number("number")).withColumn(
        "_rich", F.length(F.coalesce("scope", F.lit(""))) + F.length(F.coalesce("description", F.lit(""))))
    best = F.max_by(F.struct("ordinal", "title", "scope", "description", "category", "status"),
                    F.struct("_rich", -F.col("ordinal")))
    winners = keyed.groupBy("number").agg(best.alias("w"), F.array_sort(F.collect_set("source")).alias("sources"))
    words = keyed.select("number", "ordinal", F.posexplode("keywords").alias("pos", "word")).join(
        winners.select("number", F.col("w.ordinal").alias("_from")), "number").filter(F.col("ordinal") >= F.col("_from"))
    first = words.groupBy("number", "word").agg(F.min(F.struct("ordinal", "pos")).alias("at"))
    lists = first.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("k"))
    merged = winners.join(lists, "number", "left").select(
        "number", "w.title", F.coalesce("w.scope", F.lit("")).alias("scope"),
        F.coalesce("w.description", F.lit("")).alias("description"), "w.category",
        N.family_key("number", "prefix").alias("family"), F.lower(F.coalesce("w.status", F.lit("active"))).alias("status"),
        F.coalesce(F.col("k.word"), F.array().cast("array<string>")).alias("keywords"), "sources",
        F.lit(False).alias("verified"))
    good, rejects = map_vocab(merged, "category", categories)
    prefixes = categories.select(F.col("canonical").alias("category"), "prefix").distinct()
    return assign_ids(good.join(prefixes, "category"), "prefix", ["number"], F.col("prefix"), width), rejects


def expand_corpus(base: DataFrame, additions: DataFrame, provenance: str) -> DataFrame:
    """Base records plus additions whose normalised number is new, tagged with their provenance."""
    base = base.withColumn("number", N.normalize_number("number"))
    new = additions.withColumn("number", N.normalize_number("number")).join(base.select("number"), "number", "left_anti")
    return base.withColumn("provenance", F.lit("curated")).unionByName(
        new.withColumn("provenance", F.lit(provenance)), allowMissingColumns=True)


def full_corpus_outcomes(curated: DataFrame, ingested: DataFrame, sectors: DataFrame) -> DataFrame:
    """Ingested rows with tidied scope, keywords and ``outcome``: kept, duplicate, bad_scope or other_sector.

    ``ingested(ordinal, number, title, scope, category)``, ``sectors(category)``: those wanted. A number is taken by the curated corpus or
    by its first usable ingested row; later rows of it are duplicates.
    """
    rows = ingested.withColumn("number", N.normalize_number("number")).withColumn("scope", X.tidy_scope("scope"))
    rows = rows.withColumn("_usable", X.usable_text("scope"))
    held = curated.select(N.normalize_number("number").alias("number")).distinct().withColumn("_held", F.lit(True))
    rows = rows.join(held, "number", "left")
    rows = rows.join(sectors.select("category").distinct().withColumn("_sector", F.lit(True)), "category", "left")
    can = F.col("_held").isNull() & F.col("_usable") & F.col("_sector").isNotNull()
    taken = rows.groupBy("number").agg(F.min(F.when(can, F.col("ordinal"))).alias("_taken"))
    rows = rows.join(taken, "number")
    outcome = (
        F.when(F.col("_held").isNotNull() | (F.col("ordinal") > F.col("_taken")), "duplicate")
        .when(~F.col("_usable"), "bad_scope")
        .when(F.col("_sector").isNull(), "other_sector").otherwise("kept"))
    rows = rows.withColumn("outcome", outcome).withColumn("keywords", X.keywords("title", "scope"))
    return rows.withColumn("family", N.family_key("number", "prefix")).drop("_usable", "_held", "_taken", "_sector")


def overlay_merge(full: DataFrame, curated: DataFrame) -> DataFrame:
    """Archive breadth with curated fields on top, keyed by (base, part, edition year).

    ``full(ordinal, number, title, scope, status, superseded_by_number)`` where number carries the
    year; ``curated(id, number, edition_year, title, scope, status, aliases, superseded_by)``. The
    first archive row of a key wins, a curated row keeps its id and every non-empty field, curated
    rows without a counterpart are kept, and a successor number becomes the successor's id.
    """
    parsed = full.withColumn("_n", N.archive_number("number")).filter(F.col("_n.base").isNotNull())
    first = parsed.groupBy("_n").agg(F.min_by(F.struct("title", "scope", "status"), "ordinal").alias("r"),
                                     F.min_by("superseded_by_number", F.when(F.col("superseded_by_number").isNotNull(), F.col("ordinal"))).alias("next"))
    key = ["base", "part", "year"]
    left = first.select("_n.*", X.clean_title("r.title").alias("a_title"), F.trim(F.coalesce("r.scope", F.lit(""))).alias("a_scope"),
                        F.coalesce("r.status", F.lit("active")).alias("a_status"), "next")
    cur = curated.withColumn("_n", N.archive_number("number")).filter(F.col("_n.base").isNotNull()).select(
        F.col("_n.base").alias("base"), F.col("_n.part").alias("part"), F.col("edition_year").alias("year"),
        F.col("id").alias("c_id"), F.col("title").alias("c_title"), F.col("scope").alias("c_scope"),
        F.col("status").alias("c_status"), F.col("aliases").alias("c_aliases"), F.col("superseded_by").alias("c_next"))
    a, c = left.alias("a"), cur.alias("c")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"c.{k}")) for k in key])
    both = a.join(c, on, "full").select(*[F.coalesce(f"a.{k}", f"c.{k}").alias(k) for k in key], "a_title", "a_scope",
                                        "a_status", "next", "c_id", "c_title", "c_scope", "c_status", "c_aliases", "c_next")

    def text(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(""))

    made = N.make_id("base", "part", "year")
    merged = both.select(
        *key, F.coalesce("c_id", made).alias("id"), F.coalesce(text("c_title"), "a_title").alias("title"),
        F.coalesce(text("a_scope"), text("c_scope"), F.lit("")).alias("scope"),
        F.coalesce("a_status", "c_status").alias("status"),
        F.when(F.size("c_aliases") > 0, F.col("c_aliases")).otherwise(F.array().cast("array<string>")).alias("aliases"),
        "c_next", N.archive_number("next").alias("_s"),
        F.when(F.col("a_title").isNull(), "curated_only").when(F.col("c_id").isNotNull(), "overlaid").otherwise("archive").alias("origin"))
    ids = merged.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("id").alias("_next_id"))
    match = ((F.col("_s.base") == F.col("_base")) & F.col("_s.part").eqNullSafe(F.col("_part"))
             & F.col("_s.year").eqNullSafe(F.col("_year")))
    return merged.join(ids, match, "left").withColumn(
        "superseded_by", F.coalesce("c_next", "_next_id")).drop("c_next", "_s", "_next_id", *[f"_{k}" for k in key])


# ---- supersession ----------------------------------------------------------------------------

def family_leaders(std: DataFrame, by: list[str], year: str = "edition_year", key: str = "id") -> DataFrame:
    """(by…, n, top_year, top_n, top_id): size and newest edition of each family.

    Two aggregation levels, the first by (family, year), so a huge family arrives pre-reduced.
    """
    years = std.groupBy(*by, year).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_id"))
    newest = F.max(F.struct(F.col(year), F.col("_n"), F.col("_id")))
    return years.groupBy(*by).agg(F.sum("_n").alias("n"), newest.alias("_t")).select(
        *by, "n", F.col(f"_t.{year}").alias("top_year"), F.col("_t._n").alias("top_n"), F.col("_t._id").alias("top_id"))


def derive_supersession(std: DataFrame) -> DataFrame:
    """Mark older editions superseded by the single newest edition of their family.

    ``std(id, family, edition_year, status, superseded_by, supersession_source)``. Rows with a
    recorded successor, a curated source or another status are left alone, and so is a family whose
    newest year is claimed twice. Adds ``outcome``: newest, marked, left_alone, ambiguous or single.
    """
    known = std.filter(F.col("family").isNotNull() & F.col("edition_year").isNotNull())
    joined = std.join(family_leaders(known, ["family"]), "family", "left")
    in_family = F.col("n").isNotNull() & F.col("edition_year").isNotNull()
    touched = F.col("superseded_by").isNotNull() | F.coalesce(F.col("supersession_source") == "curated", F.lit(False))
    other = ~F.coalesce("status", F.lit("")).isin("", "active")
    outcome = (
        F.when(~in_family | (F.col("n") < 2), "single").when(F.col("top_n") > 1, "ambiguous")
        .when(F.col("edition_year") == F.col("top_year"), "newest").when(touched | other, "left_alone").otherwise("marked"))
    out = joined.withColumn("outcome", outcome)
    marked = F.col("outcome") == "marked"
    return (out.withColumn("status", F.when(marked, "superseded").otherwise(F.col("status")))
            .withColumn("superseded_by", F.when(marked, F.col("top_id")).otherwise(F.col("superseded_by")))
            .withColumn("supersession_source", F.when(marked, "derived_from_edition_year").otherwise(F.col("supersession_source")))
            .withColumn("newest_id", F.when(F.col("outcome").isin("newest", "marked", "left_alone"), F.col("top_id")))
            .drop("n", "top_year", "top_n", "top_id"))


def supersedes_links(derived: DataFrame) -> DataFrame:
    """(newest id, older id) back-links of a derived corpus."""
    return derived.filter(F.col("newest_id").isNotNull() & (F.col("newest_id") != F.col("id"))).select(
        F.col("newest_id").alias("id"), F.col("id").alias("supersedes"))


def _read_review(std: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(editions as (id, edition_year, base, part), rows with the size and newest edition of the family they name, and their successor)."""
    parsed = std.withColumn("_p", N.review_number("number")).filter(F.col("_p.base").isNotNull()).select(
        "id", "edition_year", F.col("_p.base").alias("base"), F.coalesce("_p.part", F.lit("")).alias("part"))
    held = family_leaders(parsed, ["base", "part"])
    dated = parsed.groupBy("base", "part", F.col("edition_year").alias("year")).agg(F.min("id").alias("_pick"))
    r = rows.withColumn("_p", N.review_number("number")).filter(F.col("_p.base").isNotNull()).withColumn(
        "_s", N.review_number(F.when(~F.coalesce("superseded_by", F.lit("")).rlike(r"^[-—\s]*$"), F.col("superseded_by"))))
    r = r.select("ordinal", "category", F.col("_p.base").alias("base"), F.coalesce("_p.part", F.lit("")).alias("part"),
                 F.col("_p.year").alias("year"), F.col("_s.base").alias("s_base"),
                 F.coalesce("_s.part", F.lit("")).alias("s_part"), F.col("_s.year").alias("s_year"))
    r = r.join(held.select("base", "part", "n", F.col("top_id").alias("newest")), ["base", "part"], "left")
    nxt = held.select(F.col("base").alias("s_base"), F.col("part").alias("s_part"), F.col("top_id").alias("_any"))
    exact = dated.select(F.col("base").alias("s_base"), F.col("part").alias("s_part"), F.col("year").alias("s_year"), F.col("_pick").alias("_exact"))
    r = r.join(nxt, ["s_base", "s_part"], "left").join(exact, ["s_base", "s_part", "s_year"], "left")
    r = r.withColumn("successor", F.when(F.col("s_year").isNotNull(), F.col("_exact")).otherwise(F.col("_any")))
    return parsed, r


def review_outcomes(std: DataFrame, rows: DataFrame) -> DataFrame:
    """What each row of an authoritative review table does to each edition it names.

    ``std(id, number, edition_year)``; ``rows(ordinal, number, category, superseded_by)``. Outcomes:
    applied, unmatched, ambiguous (edition not held, or several held and no year given), refused
    (newest edition with no successor). Only ``applied`` rows carry a status.
    """
    parsed, r = _read_review(std, rows)
    by_year = r.filter(F.col("year").isNotNull()).join(
        parsed.select("base", "part", F.col("edition_year").alias("year"), F.col("id").alias("target")), ["base", "part", "year"], "left")
    only = r.filter(F.col("year").isNull()).withColumn("target", F.when(F.col("n") == 1, F.col("newest")))
    both = by_year.unionByName(only)
    outcome = (F.when(F.col("n").isNull(), "unmatched").when(F.col("target").isNull(), "ambiguous")
               .when(F.col("successor").isNull() & (F.col("target") == F.col("newest")), "refused").otherwise("applied"))
    both = both.withColumn("outcome", outcome)
    applied = F.col("outcome") == "applied"
    return both.select(
        "ordinal", "base", "target", "outcome", "category", F.when(applied, F.col("successor")).alias("successor"),
        F.when(applied, F.when(F.col("successor").isNull(), "withdrawn").otherwise("superseded")).alias("status"),
        (applied & F.col("successor").isNotNull() & (F.col("s_base") != F.col("base"))).alias("cross_number"))


def apply_review(std: DataFrame, rows: DataFrame) -> DataFrame:
    """Corpus with the review applied; for one edition the last row wins, and a successor once named stays.

    Rows are reduced to the last one, and the last one with a successor, of each edition they name before they meet the editions, so no
    pair of a row and an edition is made.
    """
    parsed, r = _read_review(std, rows)
    edition = ["base", "part", "year"]
    named = F.col("successor").isNotNull()
    value = F.struct("ordinal", F.when(named, "superseded").otherwise("withdrawn").alias("status"), "category", "successor")
    per = r.filter(F.col("n").isNotNull() & F.col("ordinal").isNotNull()).groupBy(*edition).agg(
        F.max(value).alias("_all"), F.max(F.when(named, value)).alias("_named"), F.max("n").alias("n"), F.max("newest").alias("newest"))
    dated = parsed.select("base", "part", F.col("edition_year").alias("year"), "id").join(per, edition)
    only = per.filter(F.col("year").isNull() & (F.col("n") == 1)).withColumn("id", F.col("newest"))
    # a row without a successor is refused by the newest edition
    own = F.when(F.col("id") == F.col("newest"), F.col("_named")).otherwise(F.col("_all"))
    met = dated.select("id", own.alias("_all"), "_named").unionByName(only.select("id", own.alias("_all"), "_named"))
    last = met.groupBy("id").agg(F.max("_all").alias("_a"), F.max("_named").alias("_n")).filter(F.col("_a").isNotNull()).select(
        "id", F.col("_a.status").alias("_status"), F.col("_a.category").alias("bis_review_category"), F.col("_n.successor").alias("_next"))
    out = std.join(last, "id", "left")
    return (out.withColumn("status", F.coalesce("_status", "status"))
            .withColumn("superseded_by", F.coalesce("_next", "superseded_by"))
            .withColumn("supersession_source", F.when(F.col("_status").isNotNull(), "bis_standards_review")
                        .otherwise(F.col("supersession_source"))).drop("_status", "_next"))


# ---- merging and change detection ------------------------------------------------------------

def merge_records(existing: DataFrame, ingested: DataFrame, document_fields: list[str], defaults: dict[str, Column]) -> DataFrame:
    """Ingested document fields refresh a record when non-empty, everything else is kept; new ids get
    defaults. A record whose scope was read from its document has high confidence. Adds ``change``."""
    fields = [c for c in existing.columns if c != "id"]
    new = ingested.select("id", *[F.col(c).alias(f"_{c}") for c in ingested.columns if c != "id"], F.lit(True).alias("_in"))
    both = existing.withColumn("_ex", F.lit(True)).join(new, "id", "full")
    fresh, out = F.col("_ex").isNull(), [F.col("id")]
    for c in fields:
        incoming = F.col(f"_{c}") if f"_{c}" in new.columns else F.lit(None)
        if c in document_fields:
            usable = F.when(incoming.cast("string") != "", incoming)
            value = F.coalesce(usable, F.col(c))
        else:
            value = F.col(c)
        made = F.coalesce(incoming, defaults[c]) if c in defaults else incoming
        value = F.when(fresh, made).otherwise(value)
        if c == "data_confidence":
            value = F.when(~fresh & (F.coalesce(F.col("_scope"), F.lit("")) != ""), F.lit("high")).otherwise(value)
        out.append(value.alias(c))
    change = F.when(fresh, "added").when(F.col("_in").isNotNull(), "updated").otherwise("untouched")
    return both.select(*out, change.alias("change"))


def snapshot(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    return df.select(F.col(key).alias("id"), content_hash(*fields).alias("hash"))


def snapshot_diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(id, change): added, changed or removed between two (id, hash) snapshots."""
    both = current.withColumnRenamed("hash", "_new").join(previous.withColumnRenamed("hash", "_old"), "id", "full")
    change = (F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
              .when(F.col("_old") != F.col("_new"), "changed"))
    return both.select("id", change.alias("change")).filter(F.col("change").isNotNull())


def needs_embedding(corpus: DataFrame, text: str, model: str, cache: DataFrame) -> DataFrame:
    """Rows whose (text, model) key is not among the stored vectors' keys."""
    keyed = corpus.withColumn("cache_key", F.sha2(F.concat(F.col(text), F.lit("\x00"), F.lit(model)), 256))
    return keyed.join(cache.select("cache_key"), "cache_key", "left_anti")


# ---- validation ------------------------------------------------------------------------------

def validate(std: DataFrame, edges: DataFrame, statuses=("active", "superseded"), required=("title", "scope"),
             id_pattern: str = r"^[A-Za-z0-9_\-]+$") -> DataFrame:
    """Problem rows (rule, key, detail): missing text, bad ids, dates and states, empty keyword lists,
    duplicates, unresolvable successors and edges whose ends are not held."""
    def rows(df: DataFrame, rule: str, key: str, detail: Column) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), detail.cast("string").alias("detail"))

    checks = [rows(std.filter(F.coalesce(F.trim(c), F.lit("")) == ""), "empty", "id", F.lit(c)) for c in required]
    checks.append(rows(std.filter(~F.coalesce(F.col("id").rlike(id_pattern), F.lit(False))), "id_format", "id", F.col("id")))
    checks.append(rows(std.filter(~F.coalesce(F.col("status").isin(*statuses), F.lit(False))), "status", "id", F.col("status")))
    dated = F.try_to_date("last_amended", "yyyy-MM-dd")
    checks.append(rows(std.filter(dated.isNull()), "date", "id", F.col("last_amended")))
    blank = F.exists("keywords", lambda k: F.trim(k) == "")
    checks.append(rows(std.filter(F.coalesce((F.size("keywords") <= 0) | blank, F.lit(True))), "keywords", "id", F.lit(None)))
    for c in ("id", "number"):
        checks.append(rows(duplicates(std, c), f"duplicate_{c}", c, F.col("n")))
    held = std.select("id").distinct()
    for side in ("source_id", "target_id"):
        loose = edges.join(held, edges[side] == held["id"], "left_anti")
        checks.append(rows(loose, f"dangling_{side}", side, F.col("type")))
    named = std.filter(F.col("superseded_by_number").isNotNull())
    lost = named.join(std.select(F.col("number").alias("superseded_by_number")).distinct(), "superseded_by_number", "left_anti")
    checks.append(rows(lost, "successor_missing", "id", F.col("superseded_by_number")))
    resolved = named.join(std.select(F.col("number").alias("superseded_by_number")).distinct(), "superseded_by_number", "left_semi")
    ok = resolved.select("id").distinct().withColumn("_ok", F.lit(True))
    fam = std.join(ok, "id", "left").groupBy("family").agg(
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if((F.col("status") == "superseded") & F.col("_ok").isNull()).alias("stuck"))
    checks.append(rows(fam.filter((F.col("active") == 0) & (F.col("stuck") > 0)), "family_without_active", "family", F.col("stuck")))
    return reduce(DataFrame.unionByName, checks)


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def write_if_valid(df: DataFrame, problems: DataFrame, path: str, write: bool = False) -> bool:
    """Write only when asked and when there is not a single problem row; says whether it wrote."""
    if not write or not problems.isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def guard_unverified(df: DataFrame, production: bool, allow: bool = False) -> DataFrame:
    """Pass rows through, but refuse a production load that holds unverified ones."""
    if production and not allow and not df.filter(~F.coalesce("verified", F.lit(False))).isEmpty():
        raise ValueError("unverified rows may not be loaded in production")
    return df


# ---- archive ingest --------------------------------------------------------------------------

def ingest_documents(raw: DataFrame) -> DataFrame:
    """Archive rows (ordinal, item_id, title, text) with extracted fields and ``skip_reason``.

    Reasons, in order: bad_id, bad_title, duplicate, no_text, no_scope, no_sector; NULL is kept.
    """
    pattern = r"^gov\.in\.is\.(\d+)(?:\.(\d+))?\.(\d{4})$"
    base, part, year = (X.found("item_id", pattern, i) for i in (1, 2, 3))
    number = F.concat(F.lit("IS "), base, F.coalesce(F.concat(F.lit(" (Part "), part, F.lit(")")), F.lit("")), F.lit(":"), year)
    d = raw.withColumn("number", number).withColumn("title", X.archive_title("title"))
    bad_title = (F.col("title") == "") | F.col("title").rlike(V.EXCLUDED_TITLE)
    eligible = F.col("number").isNotNull() & ~bad_title
    first = d.filter(eligible).groupBy("number").agg(F.min("ordinal").alias("_first"))
    d = d.join(first, "number", "left")
    d = d.withColumn("scope", E.archive_scope(X.clean_ocr("text")))
    d = d.withColumn("category", X.classify(F.concat("title", F.lit(" "), F.coalesce("scope", F.lit("")))))
    reason = (F.when(F.col("number").isNull(), "bad_id").when(bad_title, "bad_title")
              .when(F.col("ordinal") > F.col("_first"), "duplicate")
              .when(F.coalesce("text", F.lit("")) == "", "no_text").when(F.col("scope").isNull(), "no_scope")
              .when(F.col("category").isNull(), "no_sector"))
    return d.withColumn("skip_reason", reason).withColumn("version", year).drop("_first", "text")
