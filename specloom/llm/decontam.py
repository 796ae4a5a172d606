"""Benchmark decontamination by greedy string tiling.

(1) Every document's token 5-grams are hashed with a rolling hash (Karp-Rabin) and tested against a bitmap of fixed
size of the benchmark's 5-grams; documents with a hit keep the hit tokens and their positions. (2) The hit 5-grams join the
benchmark's: shared-token seeds. A pair stays if the seeds can cover enough of the test item, which no
tiling can exceed. (3) For each pair left the longest matches of unmarked tokens are marked again and again until
none has five tokens; the tiles' share of the item is its coverage. Tiles may stand in any order, so reordered passages count.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.llm.common import cut, release_memory, row_key

BITMAP_BITS = 24
BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores, lower-cased."""
    import re

    return re.findall(r"\w+", (text or "").lower())


class TokenHashes(dict):
    """64-bit hashes of tokens; emptied at 200,000 entries and after each task."""

    def __missing__(self, token: str) -> int:
        import xxhash

        if len(self) >= 200_000:
            self.clear()
        self[token] = h = xxhash.xxh64_intdigest(token.encode("utf-8", "replace"))
        return h


_hashes = TokenHashes()


def hashed(text: str | None) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, tokens(text)), np.uint64)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all windows of ``k`` token hashes, modulo 2^64."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = h[:len(h) - k + 1] * np.uint64(1)
    for i in range(1, k):
        out = out * BASE + h[i:len(h) - k + 1 + i]
    return out ^ (out >> np.uint64(29))


def tile(doc: np.ndarray, at: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in the item, start in the document, tokens) of each tile.

    ``doc`` are token hashes standing at positions ``at``. In each round running Karp-Rabin looks up the item's windows
    of the round's length among the document's, extends matches over unmarked tokens, and marks the longest
    ones that do not overlap (ties: first in the item, then in the document). The length then falls to what was
    left over, until it would be below ``least``.
    """
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    joined = np.append(np.diff(at) == 1, False)  # is the next stored token the next of the text
    tiles: list[tuple[int, int, int]] = []
    grams = rolling(doc, least)
    whole = np.ones(len(grams), bool)
    for i in range(least - 1):
        whole &= joined[i:i + len(grams)]
    places = defaultdict(list)
    for d in np.flatnonzero(whole & np.isin(grams, rolling(item, least))):
        places[int(grams[d])].append(int(d))
    item_grams = rolling(item, least).tolist()
    while True:
        longest, found = least, []
        for i, g in enumerate(item_grams):
            if not free_item[i:i + least].all():
                continue
            for d in places.get(g, ()):
                if not free_doc[d:d + least].all():
                    continue
                if i and free_item[i - 1] and d and joined[d - 1] and free_doc[d - 1] and item[i - 1] == doc[d - 1]:
                    continue  # inside a longer match
                n = 0
                while i + n < len(item) and d + n < len(doc) and free_item[i + n] and free_doc[d + n] and item[i + n] == doc[d + n] and (not n or joined[d + n - 1]):
                    n += 1
                if n > longest:
                    longest, found = n, [(i, d)]
                elif n == longest:
                    found.append((i, d))
        if not found:
            return tiles
        for i, d in found:
            if free_item[i:i + longest].all() and free_doc[d:d + longest].all():
                free_item[i:i + longest] = free_doc[d:d + longest] = False
                tiles.append((i, int(at[d]), longest))


def benchmark_items(benchmark: DataFrame, least: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, n, k, toks binary, grams array) of each distinct (id, text) that has a token; k is ``least``, or the tokens of a shorter item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, h) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if len(h := hashed(t))]
            ks = [min(least, len(h)) for _, h in rows]
            cols = [[i for i, _ in rows], [len(h) for _, h in rows], ks, [h.tobytes() for _, h in rows], [rolling(h, k).view(np.int64).tolist() for (_, h), k in zip(rows, ks)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())))], names=["item", "n", "k", "toks", "grams"])

    return benchmark.select(F.col(item_id).cast("long"), text).distinct().mapInArrow(run, "item long, n int, k int, toks binary, grams array<long>")


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.6, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs (doc_id, key, item_id, n_tiles, longest, coverage) with tiles over ``coverage`` or more of the item's tokens.

    0.6 and not the 0.8 of plain near-duplicates, because every cut of a reordered passage may cost up to four
    tokens on each side. Items of fewer than ``least`` tokens must stand whole. Items and documents
    without a token never match; repeated documents share their key and come once, repeated items once; null ids stay null; an empty
    table on either side gives no rows; extra columns are left out.
    """
    spark = docs.sparkSession
    items = cut(benchmark_items(benchmark, least, item_id, item_text))
    ks = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most ``least`` numbers
    seeds = items.select("item", "toks", "n", "k", F.posexplode("grams").alias("pos", "seed"))
    mask = (1 << BITMAP_BITS) - 1
    words = items.select(F.explode("grams").alias("seed")).select((F.col("seed").bitwiseAND(F.lit(mask))).alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(b & 63 AS INT))")).alias("bits")).toArrow()  # 2^18 rows at most
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    bitmap[words["w"].to_numpy()] = words["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(bitmap)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value.view(np.uint64)
        for b in batches:
            out: list[tuple] = []
            for i, t in enumerate(b.column(2)):
                h = hashed(t.as_py())
                kept, found = np.zeros(len(h), bool), []
                for k in ks:
                    grams = rolling(h, k)
                    low = (grams & np.uint64(mask)).astype(np.int64)
                    at = np.flatnonzero((held[low >> 6] >> (low & 63).astype(np.uint64)) & np.uint64(1))
                    if len(at):
                        found.append(np.unique(grams[at]))
                        for j in range(k):
                            kept[at + j] = True
                if found:
                    at = np.flatnonzero(kept)
                    out.append((b.column(0)[i].as_py(), b.column(1)[i].as_py(), np.unique(np.concatenate(found)).view(np.int64).tolist(), at.astype("<i8").tobytes(), h[at].tobytes()))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()))], names=["doc_id", "key", "seeds", "at", "toks"])
        _hashes.clear()
        release_memory()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(doc_id, text).alias("key"), F.col(text).alias("text"))
    found = cut(rows.mapInArrow(hits, "doc_id long, key long, seeds array<long>, at binary, toks binary")).dropDuplicates(["key"])
    met = found.select("key", F.explode("seeds").alias("seed")).join(seeds.select("item", "toks", "n", "k", "pos", "seed"), "seed")
    # an item's covered tokens if all its seeds were tiles: no position is repeated, each gram covers k
    reach = met.groupBy("key", "item", "toks", "n", "k").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    covered = F.aggregate("p", F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")), lambda a, p: F.struct(
        (a["sum"] + F.col("k") - F.greatest(F.lit(0), a["end"] - p)).alias("sum"), (p + F.col("k")).alias("end")))["sum"]
    able = reach.where(covered >= F.col("n") * coverage).select("key", "item", F.col("toks").alias("item_toks"))
    pairs = able.join(found.select("doc_id", "key", "at", "toks"), "key").select("doc_id", "key", "item", "item_toks", "at", "toks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, key, item, item_toks, at, toks in zip(*[c.to_pylist() for c in b.columns]):
                want = np.frombuffer(item_toks, np.uint64)
                tiles = tile(np.frombuffer(toks, np.uint64), np.frombuffer(at, "<i8"), want, min(least, len(want)))
                out.append((d, key, item, len(tiles), max((n for *_, n in tiles), default=0), sum(n for *_, n in tiles) / len(want)))
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()))], names=["doc_id", "key", "item_id", "n_tiles", "longest", "coverage"])

    return pairs.mapInArrow(run, "doc_id long, key long, item_id long, n_tiles int, longest int, coverage double").where(F.col("coverage") >= coverage)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without those that hold a benchmark item; all columns stay. The keys of leaks are joined, not collected."""
    leaks = cut(find_leaks(docs, benchmark, **options).select(F.col("key").alias("_leak")).distinct())
    marked = docs.withColumn("_key", row_key(options.get("doc_id", "doc_id"), options.get("text", "text")))
    return marked.join(leaks, marked["_key"] == leaks["_leak"], "left_anti").drop("_key")
