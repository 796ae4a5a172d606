"""Similar scopes and disputed citations: pairs above a threshold, without forming the pairs below it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specloom.functions.text import tokens
from specloom.operators.ranking import salted_join, topk
from specloom.session import cut_lineage


def distinct_scopes(corpus: DataFrame, key: str, scope: str, variant: str = "alnum") -> DataFrame:
    """(key, words, n, members): one row for each distinct set of words, under the smallest key that has it. Records without a
    word take no part. A group of copies of any size is one row."""
    words = F.array_sort(F.array_distinct(tokens(scope, variant)))
    sets = corpus.select(F.col(key).alias("key"), words.alias("words")).filter(F.size("words") > 0)
    return sets.groupBy("words").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("members")).select("key", "words", F.size("words").alias("n"), "members")


def scope_overlap(corpus: DataFrame, threshold: float = 0.5, top: int = 5, key: str = "id", scope: str = "scope", variant: str = "alnum", salts: int = 8) -> DataFrame:
    """(id, other, overlap, rank): for each distinct scope its ``top`` others with the highest Jaccard similarity of ``threshold`` or more, ties by id.
    Scopes with equal words count once, under their smallest id (``distinct_scopes`` tells how many they are).

    Sets are dealt into blocks of like size, and two blocks whose sizes can reach the threshold meet in one task (``nearest_sets``), which gives each of its sets
    its ``top`` others. So no row is made for a pair, and the shuffle holds a set as often as its block meets others; the time grows with the square of the sets.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold lies in (0, 1]")
    sets = cut_lineage(distinct_scopes(corpus, key, scope, variant))
    each = sets.select("key", "n", F.explode("words").alias("word"))
    df = numbered(each.select("word").distinct(), "word")
    coded = salted_join(each, df, ["word"], "key", salts).groupBy("key", "n").agg(F.collect_list("no").alias("words"))
    near = nearest_sets(cut_lineage(coded), threshold, top)
    # written, so that no block is compared again: rows are bounded by ``top`` for each set and block that it meets
    near = cut_lineage(near.select(F.struct("id", "n").alias("a"), F.struct("other", "m", "both").alias("b")))
    overlap = F.round(F.col("b.both") / (F.col("a.n") + F.col("b.m") - F.col("b.both")), 9)
    return topk(near.select("a.id", "b.other", overlap.alias("overlap")), ["id"], ["-overlap", "other"], top)


def numbered(words: DataFrame, word: str) -> DataFrame:
    """(word, no): the distinct ``words`` under numbers from 0 without gaps, of four bytes each."""
    given = cut_lineage(cut_lineage(words).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    parts = given.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_many"))  # as many rows as there are tasks
    before = parts.select("_part", (F.sum("_many").over(Window.orderBy("_part")) - F.col("_many")).alias("_before"))
    at = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return cut_lineage(given.withColumn("_part", part).join(F.broadcast(before), "_part").select(word, at.cast("int").alias("no")))


def nearest_sets(sets: DataFrame, threshold: float, top: int, block: int = 16384, least_blocks: int = 16, tile: int = 1024) -> DataFrame:
    """(id, other, n, m, both): for each of ``sets(key, n, words)`` at least its ``top`` others with the highest Jaccard similarity of ``threshold`` or more (rounded to nine
    digits, ties by key), with the sizes of both sets and of what they share. ``words`` are numbers.

    Blocks of at most about ``block`` sets follow one another by size; a task has two blocks, compares them by tiles and keeps ``top`` others of a set.
    """
    spark, kind = sets.sparkSession, sets.schema["key"].dataType.simpleString()
    each = -(-sets.count() // least_blocks)
    each = max(1, min(block, each))
    sizes = sets.groupBy("n").agg(F.count(F.lit(1)).alias("_many"))
    sizes = cut_lineage(sizes.withColumn("_before", F.sum("_many").over(Window.orderBy("n")) - F.col("_many")))  # as many rows as there are sizes
    place = F.col("_before") + F.pmod(F.xxhash64("key"), F.col("_many"))
    dealt = cut_lineage(sets.join(sizes, "n").select(F.floor(place / each).cast("int").alias("x"), "key", "n", "words"))
    ends = dealt.groupBy("x").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).collect()  # a row for each block
    meets = [(a.x, b.x) for a in ends for b in ends if a.x <= b.x and b.lo * threshold <= a.hi + 1e-9 and a.lo * threshold <= b.hi + 1e-9]
    if not meets:
        return spark.createDataFrame([], f"id {kind}, other {kind}, n long, m long, both long")
    ways = spark.createDataFrame(sorted({(i, *m) for m in meets for i in m}), "x int, a int, b int")
    copies = dealt.join(F.broadcast(ways), "x").select("a", "b", (F.col("x") == F.col("a")).alias("left"), "key", "n", "words")

    def compare(rows: pa.Table) -> pa.Table:
        return _nearest(rows, threshold, top, tile)

    return copies.repartition(2 * len(meets), "a", "b").groupBy("a", "b").applyInArrow(compare, f"id {kind}, other {kind}, n long, m long, both long")


def _nearest(rows: pa.Table, threshold: float, top: int, tile: int, dense: int = 1024) -> pa.Table:
    """What each set of two blocks (``left`` true and false; all true: one block) has in common with those of the other that are most like it.

    The words that most sets here have are counted by products of matrices, the others by the places where they meet.
    """
    keys, words = rows["key"].combine_chunks(), rows["words"].combine_chunks()
    n = rows["n"].to_numpy().astype(np.int64)
    first = rows["left"].to_numpy()
    codes, many = np.unique(words.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)[1:]
    order = np.argsort(-many, kind="stable")
    number = np.empty(len(many), np.int32)
    number[order] = np.arange(len(many), dtype=np.int32)  # the commonest word is 0
    codes = number[codes]
    single = many[order] < 2
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64))])
    by_key = np.empty(len(keys), np.int64)
    by_key[pc.sort_indices(keys).to_numpy()] = np.arange(len(keys))

    def tiles(places: np.ndarray) -> list[tuple]:
        """(places, marks of the common words, the other words in order, the rows that have them) of sets by size."""
        places = places[np.argsort(n[places], kind="stable")]
        made = []
        for at in range(0, len(places), tile):
            own = places[at:at + tile]
            sizes = starts[own + 1] - starts[own]
            here = codes[np.repeat(starts[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
            row = np.repeat(np.arange(len(own), dtype=np.int32), sizes)
            marks = np.zeros((len(own), dense), np.float32)
            often = here < dense
            marks[row[often], here[often]] = 1
            rest = ~often & ~single[here]
            here, row = here[rest], row[rest]
            by = np.argsort(here, kind="stable")
            made.append((own, marks, here[by], row[by]))
        return made

    found = []

    def keep(a: np.ndarray, b: np.ndarray, both: np.ndarray, alike: np.ndarray) -> None:
        """The ``top`` others in ``b`` of each of ``a``."""
        i, j = np.nonzero(alike >= threshold)
        if len(i):
            by = np.lexsort((by_key[b[j]], -alike[i, j], i))
            i, j = i[by], j[by]
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            i, j = i[nth < top], j[nth < top]
            found.append((a[i], b[j], both[i, j]))

    left = tiles(np.flatnonzero(first))
    one = bool(first.all())
    right = left if one else tiles(np.flatnonzero(~first))
    for at, (a, a_marks, a_words, a_rows) in enumerate(left):
        for b, b_marks, b_words, b_rows in right[at:] if one else right:
            if min(n[a[-1]], n[b[-1]]) < threshold * max(n[a[0]], n[b[0]]) - 1e-9:
                continue
            both = (a_marks @ b_marks.T).astype(np.int64)
            lo, hi = np.searchsorted(b_words, a_words, "left"), np.searchsorted(b_words, a_words, "right")
            met = hi - lo
            ends = np.cumsum(met)
            if len(ends) and ends[-1]:
                to = b_rows[np.arange(ends[-1]) + np.repeat(lo - (ends - met), met)]
                both += np.bincount(np.repeat(a_rows, met).astype(np.int64) * len(b) + to, minlength=both.size).reshape(both.shape)
            alike = np.round(both / (n[a][:, None] + n[b][None, :] - both), 9)
            if a is b:
                np.fill_diagonal(alike, -1)
            keep(a, b, both, alike)
            if a is not b:
                keep(b, a, both.T, alike.T)
    schema = pa.schema([("id", keys.type), ("other", keys.type), ("n", pa.int64()), ("m", pa.int64()), ("both", pa.int64())])
    if not found:
        return schema.empty_table()
    a, b, both = (np.concatenate(x) for x in zip(*found))
    alike = np.round(both / (n[a] + n[b] - both), 9)
    by = np.lexsort((by_key[b], -alike, a))
    a, b, both = a[by], b[by], both[by]
    best = np.arange(len(a)) - np.searchsorted(a, a) < top
    a, b, both = a[best], b[best], both[best]
    return pa.table([keys.take(pa.array(a)), keys.take(pa.array(b)), n[a], n[b], both], schema=schema)


def shared_words(pairs: DataFrame, sets: DataFrame, block: int = 4096) -> DataFrame:
    """(a, b, an, bn, both): sizes of the two sets of each of ``pairs(a, b)`` and of what they share; ``sets(key, words)``, words by number.

    A set is in very many pairs, so no pair carries one: sets are dealt into blocks of about ``block``, and one task has two blocks, each set once,
    and the pairs between them. The shuffle holds the pairs and as many copies of a set as there are blocks.
    """
    kind = sets.schema["key"].dataType.simpleString()
    blocks = max(1, -(-sets.count() // block))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    here = sets.select(of("key").alias("x"), "key", "words")
    copies = here.select("x", F.explode(every).alias("y"), "key", "words").unionByName(here.select(F.explode(every).alias("y"), "x", "key", "words").select(
        F.col("y").alias("x"), F.col("x").alias("y"), "key", "words").filter("x <> y"))
    dealt = pairs.select(of("a").alias("x"), of("b").alias("y"), "a", "b")
    return dealt.groupBy("x", "y").cogroup(copies.groupBy("x", "y")).applyInArrow(_share, f"a {kind}, b {kind}, an long, bn long, both long")


def _share(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """Pairs in the order of ``a``: its words are marked once, and the marks under the words of all its partners are counted together."""
    schema = pa.schema([("a", sets["key"].type), ("b", sets["key"].type), ("an", pa.int64()), ("bn", pa.int64()), ("both", pa.int64())])
    if not pairs.num_rows:
        return schema.empty_table()
    keys, words = sets["key"].combine_chunks(), sets["words"].combine_chunks()
    flat, sizes = words.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.unique(flat, return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    at = [pc.index_in(pairs[c].combine_chunks(), value_set=keys).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b")]
    order = np.argsort(at[0], kind="stable")
    a, b = at[0][order], at[1][order]
    both, marks = np.zeros(len(a), np.int64), np.zeros(codes.max(initial=0) + 1, np.int64)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(a)) + 1, [len(a)]])
    for lo, hi in zip(edges[:-1], edges[1:]):
        own = codes[starts[a[lo]]:starts[a[lo] + 1]]
        marks[own] = 1
        for i in range(lo, hi, 4096):
            to = b[i:min(i + 4096, hi)]
            n = sizes[to]
            ends = np.cumsum(n)
            places = np.arange(ends[-1]) + np.repeat(starts[to] - (ends - n), n)
            both[i:i + len(to)] = np.add.reduceat(marks[codes[places]], ends - n)  # no set is empty
        marks[own] = 0
    return pa.table([keys.take(pa.array(a)), keys.take(pa.array(b)), sizes[a], sizes[b], both], schema=schema)


def dispute_lift(cites: DataFrame, outcomes: DataFrame, least: int = 5) -> DataFrame:
    """(first, second, documents, disputed, lift): how much likelier a bad outcome is among the documents that cite a record (``second``
    NULL) or two records together than among all documents with an outcome.

    ``cites(doc, record)``, ``outcomes(doc, bad)``. Only records and pairs with at least ``least`` documents are listed, and pairs are
    formed of records that reach it alone, which any pair that reaches it is made of. Outcomes unknown (NULL) take no part.
    """
    known = cut_lineage(outcomes.filter(F.col("bad").isNotNull()).groupBy("doc").agg(F.max(F.col("bad").cast("int")).alias("bad")))
    base = known.agg(F.avg("bad").alias("r")).select("r").scalar()
    held = cut_lineage(cites.filter(F.col("record").isNotNull()).select("doc", "record").distinct().join(known, "doc"))
    counted = lambda df, *by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("documents"), F.sum("bad").alias("disputed")).filter(F.col("documents") >= least)
    single = cut_lineage(counted(held, "record"))
    often = cut_lineage(held.join(single.select("record"), "record", "left_semi").select("doc", "record", "bad"))
    pairs = often.select("doc", F.col("record").alias("first"), "bad").join(often.select("doc", F.col("record").alias("second")), "doc").filter("first < second")
    pairs = counted(pairs, "first", "second")
    every = single.select(F.col("record").alias("first"), F.lit(None).cast(single.schema["record"].dataType).alias("second"), "documents", "disputed").unionByName(pairs)
    lift = F.round(F.col("disputed") / F.col("documents") / F.nullif(base, F.lit(0.0)), 6)
    return every.select("first", "second", "documents", "disputed", lift.alias("lift"))
