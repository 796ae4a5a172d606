"""A Merkle manifest of a data set, by nested-interval labels.

Leaves are the hashes of rows; each value of ``tree`` (a language, say) has a tree of its own, and the trees' roots are the leaves of
one tree above them. A node is labelled with the interval of leaf ranks that it covers and with its parent's interval; labels
replace pointers:

* An ancestor's interval contains the node's interval.
* A leaf's siblings on the way up are the nodes whose parent's interval contains the leaf and whose own interval does not: what
  is left of the parent's interval without the child on the way.

Levels are bucketed into bands of ``band`` levels. All nodes of a band below one node of its upper border are a bucket of at most ``arity ** band``
lowest nodes, so the containment join is an equi-join by (tree, bucket) with the interval conditions; a bucket has the same size for a tree
of any size, and a tree that holds all rows is spread like many small ones. Only the lowest nodes of a band are joined, not all leaves with
all levels: a leaf takes the rest of its way from its ancestor at the band's border, in rounds from the top. A band costs one shuffle of its
lowest nodes, a sixteenth of those of the band below, so the whole takes about as much as its first band.

All of it is DataFrame functions; SHA-256 is Spark's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.llm.common import cut

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the roots of the trees.
UPPER = ""


def framed(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(fields: Sequence[Column]) -> Column:
    return digest(*[framed(f) for f in fields])


def placed(rows: DataFrame, order: Sequence[str], arity: int) -> DataFrame:
    """``rows`` (tree, ...) with the rank ``i`` in their tree, its size ``n`` and its height ``h``.

    Rows are dealt by ranges of the order and numbered inside a range; what a tree has in earlier ranges is added. The shift
    table has a row for each range and tree in it, so a tree of any size is spread over its ranges.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = cut(sorted_.withColumns({"_range": F.shiftright("_at", 33), "_in": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at"))
    sums = ranged.groupBy("tree", "_range").agg(F.min("_in").alias("_first"), F.count(F.lit(1)).alias("_many"))
    before = Window.partitionBy("tree").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select("tree", "_range", (F.coalesce(F.sum("_many").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_many").over(Window.partitionBy("tree")).alias("n"))
    powers = ", ".join(f"{arity ** j}L" for j in range(64) if arity ** j < 1 << 62)
    height = F.expr(f"size(filter(array({powers}), p -> p < n))")
    joined = ranged.join(shift, ["tree", "_range"])
    return joined.withColumns({"i": F.col("_in") + F.col("_shift"), "h": height}).drop("_range", "_in", "_shift")


def climbed(nodes: DataFrame, level: int, band: int, arity: int) -> DataFrame:
    """One row for each bucket of a band: tree, n, h, bucket, and ``d0`` .. ``d{band}``, the digests of its nodes at each level, left to
    right. ``nodes`` (tree, n, h, i, digest) are those of ``level``. At and above its height a tree's root goes up unchanged."""
    width = arity ** band
    own = F.transform(F.array_sort(F.collect_list(F.struct("i", "digest"))), lambda x: x["digest"])
    rows = nodes.groupBy("tree", F.expr(f"i div {width}").alias("bucket")).agg(F.first("n").alias("n"), F.first("h").alias("h"), own.alias("d0"))
    for j in range(1, band + 1):
        low = F.col(f"d{j - 1}")
        runs = F.transform(F.sequence(F.lit(0), F.expr(f"(size(d{j - 1}) - 1) div {arity}")), lambda p: F.sha2(F.array_join(F.slice(low, p * arity + 1, arity), "").cast("binary"), 256))
        rows = rows.withColumn(f"d{j}", F.when(F.col("h") >= level + j, runs).otherwise(low))
    return rows


def labelled(buckets: DataFrame, level: int, band: int, arity: int) -> DataFrame:
    """The nodes below the upper border of a band, but for roots, by their intervals: tree, bucket, level, lo, hi, up_lo, up_hi, digest."""
    def label(j: int):
        width, above = arity ** (level + j), arity ** (level + j + 1)
        first = F.col("bucket") * (arity ** (band - j))

        def of(d: Column, p: Column) -> Column:
            lo, parent = (first + p) * width, F.floor((first + p - F.pmod(first + p, F.lit(arity))) / arity)
            return F.struct(F.lit(level + j).alias("level"), lo.alias("lo"), F.least(lo + width, F.col("n")).alias("hi"), (parent * above).alias("up_lo"), F.least((parent + 1) * above, F.col("n")).alias("up_hi"), d.alias("digest"))

        return F.transform(F.col(f"d{j}"), of)

    levels = [F.when(F.col("h") > level + j, label(j)) for j in range(band)]
    each = F.explode(F.concat(*[F.coalesce(x, F.slice(label(0), 1, 0)) for x in levels]))
    return buckets.select("tree", "bucket", each.alias("x")).select("tree", "bucket", "x.*")


def ways(members: DataFrame, nodes: DataFrame, level: int, band: int, arity: int, carried: Sequence[str]) -> DataFrame:
    """``members`` (tree, n, h, i, carried columns; nodes of ``level``) with ``steps``: for each level of the band below the tree's root,
    the digests left and right of the node on the way up, each side joined."""
    width = arity ** level
    lo = F.col("i") * width
    m = members.select("tree", F.expr(f"i div {arity ** band}").alias("bucket"), "n", "h", "i", lo.alias("m_lo"), F.least(lo + width, F.col("n")).alias("m_hi"), *carried)
    x = nodes.select(F.col("tree").alias("x_tree"), F.col("bucket").alias("x_bucket"), "level", "lo", "hi", "up_lo", "up_hi", F.col("digest").alias("beside"))
    inside = (F.col("up_lo") <= F.col("m_lo")) & (F.col("m_hi") <= F.col("up_hi"))
    apart = (F.col("hi") <= F.col("m_lo")) | (F.col("lo") >= F.col("m_hi"))
    met = m.join(x, (m["tree"] == x["x_tree"]) & (m["bucket"] == x["x_bucket"]) & inside & apart, "left")
    found = F.array_sort(F.collect_list(F.when(F.col("level").isNotNull(), F.struct("level", "lo", "beside"))))
    held = met.groupBy("tree", "bucket", "i").agg(*[F.first(c).alias(c) for c in ("n", "h", "m_lo", *carried)], found.alias("found"))
    last = F.least(F.lit(level + band), F.col("h")) - 1

    def side(at: Column, left: bool) -> Column:
        there = F.filter("found", lambda s: (s["level"] == at) & ((s["lo"] < F.col("m_lo")) if left else (s["lo"] > F.col("m_lo"))))
        return F.array_join(F.transform(there, lambda s: s["beside"]), "")

    steps = F.transform(F.sequence(F.lit(level), last), lambda at: F.struct(side(at, True).alias("before"), side(at, False).alias("after")))
    none = F.expr("CAST(array() AS array<struct<before:string,after:string>>)")
    return held.select("tree", "bucket", "i", "n", *carried, F.when(last >= level, steps).otherwise(none).alias("steps"))


class Forest:
    """The trees over ``leaves`` (tree, order columns, digest, ...): their nodes, roots and ways up."""

    def __init__(self, leaves: DataFrame, order: Sequence[str], arity: int = 2, band: int = 4):
        self.arity, self.band = arity, band
        self.leaves = cut(placed(leaves, order, arity))
        height = self.leaves.agg(F.max("h")).first()[0] or 0
        self.buckets: list[DataFrame] = []
        at = self.leaves.select("tree", "n", "h", "i", "digest")
        for level in range(0, height, band):
            self.buckets.append(cut(climbed(at, level, band, arity)))
            at = self.buckets[-1].select("tree", "n", "h", F.col("bucket").alias("i"), F.get(f"d{band}", F.lit(0)).alias("digest"))
        self.roots = at.select("tree", "n", "h", F.col("digest").alias("root"))

    def nodes(self) -> DataFrame:
        """All nodes but the roots with their intervals and those of their parents."""
        out = None
        for b, rows in enumerate(self.buckets):
            part = labelled(rows, b * self.band, self.band, self.arity)
            out = part if out is None else out.unionByName(part)
        roots = self.roots.select("tree", F.lit(0).cast("long").alias("bucket"), F.col("h").alias("level"), F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi"),
                                  F.lit(None).cast("long").alias("up_lo"), F.lit(None).cast("long").alias("up_hi"), F.col("root").alias("digest"))
        return roots if out is None else out.unionByName(roots)

    def proofs(self, carried: Sequence[str], above: DataFrame) -> DataFrame:
        """Each leaf with its ``carried`` columns, the columns of ``above`` (tree, up, ...: one row for each tree, ``up`` the steps from its
        root) and ``steps`` from the leaf to the last root."""
        extra = [c for c in above.columns if c not in ("tree", "up")]
        way = above.select("tree", F.lit(0).cast("long").alias("bucket"), F.col("up").alias("rest"), *extra)
        for b in range(len(self.buckets) - 1, -1, -1):
            level = b * self.band
            if b:
                members, own = self.buckets[b - 1].select("tree", "n", "h", F.col("bucket").alias("i")), []
            else:
                members, own = self.leaves, list(carried)
            part = ways(members, labelled(self.buckets[b], level, self.band, self.arity), level, self.band, self.arity, own)
            part = part.join(way, ["tree", "bucket"]).withColumn("steps", F.concat("steps", "rest")).drop("rest")
            if b == 0:
                return part.select(*carried, *extra, "steps")
            way = cut(part.select("tree", F.col("i").alias("bucket"), F.col("steps").alias("rest"), *extra))
        # every tree is one leaf
        return self.leaves.join(way.drop("bucket"), "tree").select(*carried, *extra, F.col("rest").alias("steps"))


def folded(leaf: Column, steps: Column) -> Column:
    """The root recomputed from a leaf and the digests beside its way."""
    return F.aggregate(steps, leaf, lambda at, s: F.sha2(F.concat(s["before"], at, s["after"]).cast("binary"), 256))


def proof_digest(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, doc_id: str = "doc_id", tree: str = "lang", arity: int = 2, band: int = 4, claimed: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(proofs, nodes) of the manifest of ``docs``.

    ``proofs`` has one row per row: doc_id, leaf, claimed, subroot, root, steps (the digests before and after the way, a struct for each
    level, to the root of all). ``claimed`` is the leaf to verify (default: the leaf itself). ``nodes`` has all nodes with their intervals: tree (empty for the
    tree of subroots, else the framed value), level, lo, hi, up_lo, up_hi, digest.

    Per tree, leaves ascend by doc_id, a null doc_id first; rows that repeat an id stand by their leaf. Trees are ordered by value, null first,
    bytewise. Null fields hash as ``-``; rows that are equal in all fields are leaves of their own; an empty table gives no rows; extra columns are left out.
    """
    leaf = leaf_digest([F.col(f) for f in fields])
    key = F.col(tree).cast("string")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), key.alias("name"), framed(key).alias("tree"), leaf.alias("digest"), (leaf if claimed is None else claimed).alias("claimed"))
    rows = cut(rows.withColumn("copy", F.monotonically_increasing_id()))  # tells equal rows apart
    low = Forest(rows, ["name", "doc_id", "digest", "copy"], arity, band)
    names = rows.groupBy("tree").agg(F.first("name").alias("name"))
    subroots = cut(low.roots.join(names, "tree").select(F.lit(UPPER).alias("tree"), F.col("tree").alias("of"), "name", F.col("root").alias("digest")))
    high = Forest(subroots, ["name"], arity, band)
    none = F.expr("CAST(array() AS array<struct<before:string,after:string>>)")
    up = high.proofs(["of", "digest"], high.roots.select("tree", none.alias("up"), "root"))
    above = cut(up.select(F.col("of").alias("tree"), F.col("steps").alias("up"), F.col("digest").alias("subroot"), "root"))
    proofs = low.proofs(["doc_id", "digest", "claimed"], above).withColumnRenamed("digest", "leaf")
    return proofs, low.nodes().unionByName(high.nodes())


def changed_leaf(fields: Sequence[str], doc_id: str = "doc_id", counter: str = "n_chars", every: int = 7) -> Column:
    """The leaf with one added to ``counter`` where ``every`` divides the CRC-32 of the id in decimals (a null id: never); a null stays."""
    hit = F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(every)) == 0, F.lit(False))
    return leaf_digest([F.when(hit, F.try_add(F.col(f), F.lit(1))).otherwise(F.col(f)) if f == counter else F.col(f) for f in fields])


def verified_manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, claimed: Column | None = None, **options) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root (from the claimed leaf and the stored siblings), verified."""
    proofs, _ = manifest(docs, fields, claimed=claimed, **options)
    rows = proofs.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), folded(F.col("claimed"), F.col("steps")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
