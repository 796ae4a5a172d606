"""Table-level operators: lookups, paging, upserts, counts, remaps, enrichment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.operators.graph import best_edition
from specloom.operators.ranking import first_per_group, ordering


def page(df: DataFrame, filters: dict[str, object], order: list[str], limit: int, offset: int = 0) -> tuple[DataFrame, int]:
    """(rows of one page, total number of matches); a filter that is None is not applied."""
    kept = reduce(lambda d, kv: d.filter(F.col(kv[0]) == kv[1]) if kv[1] is not None else d, filters.items(), df)
    return kept.orderBy(*ordering(*order)).offset(offset).limit(limit), kept.count()


def contains_ci(df: DataFrame, cols: list[str], needle: str) -> DataFrame:
    """Rows where any column, or any element of an array column, contains the needle in any case."""
    low = needle.lower()
    tests = []
    for c in cols:
        if df.schema[c].dataType.typeName() == "array":
            tests.append(F.exists(c, lambda x: F.lower(x).contains(low)))
        else:
            tests.append(F.lower(F.col(c)).contains(low))
    return df.filter(reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in tests]))


def resolve_keys(wanted: DataFrame, corpus: DataFrame) -> DataFrame:
    """(wanted, id): an id as it is; else number and year; else the number's active newest edition.

    ``wanted(wanted)``, ``corpus(id, number, edition_year, status)`` with bare numbers.
    """
    w = wanted.select("wanted").distinct()
    head = F.regexp_extract("wanted", r"^(.*):\s*\d{4}\s*$", 1)
    w = w.withColumn("n", F.lower(F.trim(F.when(head != "", head).otherwise(F.col("wanted"))))).withColumn(
        "y", F.regexp_extract("wanted", r":\s*(\d{4})\s*$", 1).try_cast("int"))
    c = corpus.withColumn("n", F.lower(F.trim("number")))
    own = corpus.select(F.col("id").alias("wanted"), F.col("id").alias("_own"))
    exact = c.groupBy("n", F.col("edition_year").alias("y")).agg(F.min("id").alias("_exact"))
    best = best_edition(c, ["n"])
    return w.join(own, "wanted", "left").join(exact, ["n", "y"], "left").join(best, "n", "left").select(
        "wanted", F.coalesce("_own", "_exact", "pick").alias("id"))


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], update_cols: list[str]) -> DataFrame:
    """Target with the listed columns replaced where a key is updated, plus rows with new keys."""
    flagged = updates.withColumn("_u", F.lit(True)).withColumnsRenamed({c: f"_{c}" for c in updates.columns if c not in keys})
    both = target.withColumn("_t", F.lit(True)).join(flagged, keys, "full")
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
        elif f"_{c}" not in flagged.columns:
            out.append(F.col(c))
        elif c in update_cols:
            out.append(F.when(F.col("_u"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("_t").isNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c))
    return both.select(*out)


def insert_new(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Target plus the updates whose key it does not hold yet; repeated loads change nothing. Of updates that
    repeat a key the first by all columns is taken, on any layout."""
    first = first_per_group(updates, keys, updates.columns)
    return target.unionByName(first.join(target.select(*keys), keys, "left_anti"))


def replace_children(children: DataFrame, updates: DataFrame, parent: str) -> DataFrame:
    """Children of updated parents are replaced as a whole, all others stay."""
    return children.join(updates.select(parent).distinct(), parent, "left_anti").unionByName(updates)


def keyword_projection(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(key, search_text, document): the text to search and the record as JSON."""
    return df.select(key, F.lower(F.concat_ws(" ", *cols)).alias("search_text"), F.to_json(F.struct(*[F.col(c) for c in cols])).alias("document"))


def counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *by)


def entity_counts(tables: dict[str, DataFrame]) -> DataFrame:
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("entity"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, rows)


def coverage(df: DataFrame, checked: Column, amount: Column) -> DataFrame:
    return df.agg(F.count_if(checked).alias("checked"), F.count_if(~checked).alias("unchecked"), F.sum(F.coalesce(amount, F.lit(0))).alias("total"))


def category_counts(std: DataFrame, rules: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, n_standards, n_rules) for every category, also empty ones."""
    s = std.groupBy("category").agg(F.count(F.lit(1)).alias("n_standards"))
    r = rules.groupBy("category").agg(F.count(F.lit(1)).alias("n_rules"))
    return categories.select("category").distinct().join(s, "category", "left").join(r, "category", "left").fillna(0)


def with_successor(std: DataFrame) -> DataFrame:
    nxt = std.select(F.col("id").alias("superseded_by"), F.col("number").alias("successor_number"))
    return std.join(nxt, "superseded_by", "left")


def remap_ids(df: DataFrame, col: str, old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Replace ids of an old corpus generation by those of the new one through their natural key.

    ``old(id, key)``, ``new(id, key)``; ids without a counterpart raise instead of passing silently.
    """
    mapping = old.select(F.col("id").alias(col), key).join(new.select(F.col("id").alias("_new"), key), key).select(col, "_new")
    joined = df.join(mapping, col, "left")
    told = F.when(F.col(col).isNotNull() & F.col("_new").isNull(), F.raise_error(F.concat(F.lit("no counterpart for "), F.col(col))))
    return joined.withColumn(col, F.coalesce(told.cast("string"), F.col("_new"))).drop("_new")


def remap_id_arrays(df: DataFrame, key: str, col: str, old: DataFrame, new: DataFrame, natural: str) -> DataFrame:
    """The same for an array column, keeping element order."""
    items = df.select(key, F.posexplode(col).alias("_p", "_id"))
    mapped = remap_ids(items.withColumnRenamed("_id", "one"), "one", old, new, natural)
    lists = mapped.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_p", "one"))).alias("_l"))
    return df.join(lists, key, "left").withColumn(col, F.coalesce(F.col("_l.one"), F.array().cast("array<string>"))).drop("_l")


def enrich(hits: DataFrame, std: DataFrame, amendments: DataFrame, rules: DataFrame) -> DataFrame:
    """Ranked hits with number, amendment count, rule count and a warning for editions not in force.

    The rank column carries the order through the joins; ids that are not held drop out.
    """
    a = amendments.groupBy("id").agg(F.count(F.lit(1)).alias("n_amendments"))
    r = rules.groupBy("id").agg(F.count(F.lit(1)).alias("n_rules"))
    about = std.select(F.col("id").alias("doc"), "number", "status")
    out = hits.join(about, "doc").join(a.withColumnRenamed("id", "doc"), "doc", "left").join(r.withColumnRenamed("id", "doc"), "doc", "left")
    warn = F.when(F.col("status") != "active", F.concat("number", F.lit(" is "), "status"))
    return out.fillna(0, ["n_amendments", "n_rules"]).withColumn("warning", warn)


def dedupe_first(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return first_per_group(df, by, order)


def union_priority(high: DataFrame, low: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of ``high`` and the rows of ``low`` whose key it lacks."""
    return high.unionByName(low.join(high.select(*keys).distinct(), keys, "left_anti"))


def merge_arrays(a: str, b: str) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(a, empty), F.coalesce(b, empty)))


def shared_values(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    return a.select(col).intersect(b.select(col))


def assert_disjoint(a: DataFrame, b: DataFrame, col: str) -> None:
    if not shared_values(a, b, col).isEmpty():
        raise ValueError(f"both sets hold the same {col}")
