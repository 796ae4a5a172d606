"""SimHash near-duplicates by anchor-point covering.

The 64 bits are cut into blocks A (23 bits), B (23) and C (15; three bits more are compared, not covered).
Each block has a perfect covering code: the binary Golay code [23, 12] with covering radius 3 and the Hamming code
[15, 11] with radius 1. Every fingerprint lies within the radius of exactly one codeword of a block, its anchor.

Two fingerprints that differ in at most three bits differ in at most one bit in two of the three blocks
(leave out the one with the most). So for each two blocks a fingerprint has one home, its pair of
anchors, and is replicated to all pairs of anchors within covering radius plus one of its blocks; homes and replicas
of one anchor pair are compared in full. This finds every pair, by 28 + 40 + 40 replicas on average.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.llm.common import components, cut, release_memory, row_key, slices

#: Generator polynomials of the Golay code [23, 12] and of the Hamming code [15, 11].
GOLAY, HAMMING = 0b101011100011, 0b10011
#: First bit, width, generator and covering radius of each block.
BLOCKS = {"A": (0, 23, GOLAY, 3), "B": (23, 23, GOLAY, 3), "C": (46, 15, HAMMING, 1)}
#: Bits of an anchor pair: 12 + 12, 12 + 11 and 12 + 11 information bits, made different by an offset.
PAIRS = (("A", "B", 0), ("A", "C", 1 << 24), ("B", "C", (1 << 24) + (1 << 23)))
ANCHOR_BITS = 25
CHUNK = 50_000


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """64 majority bits over the XXH64 of all word shingles, repeats included; no word gives 0."""
    import xxhash

    words = word_list(text)
    if not words:
        return 0
    if len(words) < size:
        words = [b" ".join(words)]
        size = 1
    n, ones, digest = len(words) - size + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        part = words[at:at + CHUNK + size - 1]
        shingles = part if size == 1 else map(b" ".join, zip(*[part[i:] for i in range(size)]))
        hashes = np.fromiter([digest(s, seed) for s in shingles], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, key, fp long): whole texts; null text is empty; ``key`` is the row's ``row_key``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t.as_py(), size) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints)], names=["doc_id", "key", "fp"])
        release_memory()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(doc_id, text).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, fp long")


@cache
def block_tables(name: str) -> tuple:
    """Per block: syndromes of the low and high half words, and per syndrome the error patterns of weight
    up to radius + 1 (their xor with a word gives the codewords that near)."""
    _, width, generator, radius = BLOCKS[name]
    checks = generator.bit_length() - 1

    def remainder(v: int) -> int:
        for i in range(width - 1, checks - 1, -1):
            if v >> i & 1:
                v ^= generator << (i - checks)
        return v

    unit = [remainder(1 << i) for i in range(width)]
    half = width // 2

    def halves(first: int, n: int) -> np.ndarray:
        table = np.zeros(1, np.int64)
        for i in range(n):
            table = np.concatenate([table, table ^ unit[first + i]])
        return table

    near: list[list[int]] = [[] for _ in range(1 << checks)]
    home = np.zeros(1 << checks, np.int64)
    for weight in range(radius + 2):
        for bits in combinations(range(width), weight):
            syndrome = 0
            for i in bits:
                syndrome ^= unit[i]
            pattern = sum(1 << i for i in bits)
            near[syndrome].append(pattern)
            if weight <= radius:
                home[syndrome] = pattern
    start = np.cumsum([0, *map(len, near)])
    return halves(0, half), halves(half, width - half), half, home, start, np.concatenate([np.array(x, np.int64) for x in near]), checks


def block_anchors(fps: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home anchor of each fingerprint, row numbers, anchors within radius + 1). Code words are systematic
    in their high bits, so those number an anchor."""
    first, width, _, _ = BLOCKS[name]
    low, high, half, home, start, patterns, checks = block_tables(name)
    v = (fps >> np.uint64(first)).astype(np.int64) & ((1 << width) - 1)
    s = low[v & ((1 << half) - 1)] ^ high[v >> half]
    n = start[s + 1] - start[s]
    row = np.repeat(np.arange(len(v)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[s], n)
    return (v ^ home[s]) >> checks, row, (v[row] ^ patterns[at]) >> checks


def homes_of(fps: np.ndarray) -> np.ndarray:
    """len(fps) x 3 anchor pairs."""
    home = {b: block_anchors(fps, b)[0] for b in BLOCKS}
    return np.stack([(home[a] << (12 if b == "B" else 11)) + home[b] + at for a, b, at in PAIRS], 1)


def replicas_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, anchor pairs) of all replicas."""
    near = {b: block_anchors(fps, b)[1:] for b in BLOCKS}
    rows, anchors = [], []
    for a, b, at in PAIRS:
        (ra, xa), (rb, xb) = near[a], near[b]
        nb = np.bincount(rb, minlength=len(fps))
        begin = np.cumsum(nb) - nb
        n = nb[ra]
        left = np.repeat(np.arange(len(ra)), n)
        right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[ra], n)
        rows.append(ra[left])
        anchors.append((xa[left] << (12 if b == "B" else 11)) + xb[right] + at)
    return np.concatenate(rows), np.concatenate(anchors)


def near_pairs(prints: DataFrame, most_bits: int = 3) -> DataFrame:
    """All pairs (a, b) of the distinct ``fp`` of ``prints`` that differ in at most ``most_bits`` (up to 3) bits.

    A replica is only sent if its anchor is some fingerprint's home: the occupied anchors are one bitmap of
    2^25 bits (4 MB at any size of the corpus).
    """
    if not 0 <= most_bits <= 3:
        raise ValueError("the covering is built for at most three bits")
    spark = prints.sparkSession

    def home_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(homes_of(fps).ravel()), pa.array(np.repeat(fps.view(np.int64), 3))], names=["anchor", "fp"])

    homes = prints.mapInArrow(home_rows, "anchor long, fp long")
    bits = homes.groupBy(F.shiftright("anchor", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(anchor & 63 AS INT))")).alias("bits")).toArrow()
    words = np.zeros(1 << (ANCHOR_BITS - 6), np.int64)
    words[bits["w"].to_numpy()] = bits["bits"].to_numpy()
    occupied = spark.sparkContext.broadcast(words)

    def replica_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = occupied.value.view(np.uint64)
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            for s in slices([1] * len(fps), 4000):
                row, anchor = replicas_of(fps[s])
                live = (held[anchor >> 6] >> (anchor & 63).astype(np.uint64)) & np.uint64(1) == 1
                yield pa.RecordBatch.from_arrays([pa.array(anchor[live]), pa.array(fps[s][row[live]].view(np.int64))], names=["anchor", "other"])

    replicas = prints.mapInArrow(replica_rows, "anchor long, other long")
    pairs = homes.join(replicas, "anchor").where((F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= most_bits))
    return pairs.select(F.col("fp").alias("a"), F.col("other").alias("b")).distinct()


def group_rows(docs: DataFrame, most_bits: int = 3, size: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, fp, least): each row with the first row of its group as struct (nameless, doc_id, key): rows with an
    id before those without, then by id, then by key."""
    marked = cut(with_fingerprints(docs, doc_id, text, size))
    own = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key")
    nodes = cut(marked.groupBy("fp").agg(F.min(own).alias("low")))
    links = near_pairs(nodes.select("fp"), most_bits)
    found = cut(components(links))
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("least"))
    known = rooted.join(least, "root").select(F.col("fp").alias("node"), "least")
    return marked.join(known, marked["fp"] == known["node"]).select("doc_id", "key", "fp", "least")


def simhash_groups(docs: DataFrame, most_bits: int = 3, size: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Documents of one fingerprint are one node; component_id is the smallest doc_id reachable over
    pairs of at most ``most_bits`` differing bits. Null and empty texts have fingerprint zero and link like any
    other. A null doc_id keeps its row and is never the smallest, unless a group has none else (then null). Repeated
    rows stay; an empty table gives no rows; extra columns are left out.
    """
    rows = group_rows(docs, most_bits, size, doc_id, text)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, most_bits: int = 3, size: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Keep of each group the row with the smallest doc_id; of rows that repeat an id, the one with the smallest key;
    of rows that repeat both, one. All columns stay."""
    return keep_first(docs, group_rows(docs, most_bits, size, doc_id, text).select("key", "least"), doc_id, text)


def keep_first(docs: DataFrame, groups: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that are not the ``least`` of their group (``groups``: key, least). The keys to drop are
    joined, not collected."""
    rows = cut(groups.select("key", (F.col("key") == F.col("least.key")).alias("first")))
    keys = rows.groupBy("key").agg(F.max("first").alias("first"), F.count(F.lit(1)).alias("n"))
    gone = cut(keys.where(~F.col("first") | (F.col("n") > 1)).select(F.col("key").alias("_gone")))
    again = cut(keys.where(F.col("first") & (F.col("n") > 1)).select(F.col("key").alias("_again")))
    keyed = docs.withColumn("_key", row_key(doc_id, text))
    kept = keyed.join(gone, keyed["_key"] == gone["_gone"], "left_anti").drop("_key")
    if again.limit(1).count():
        once = keyed.join(again, keyed["_key"] == again["_again"], "left_semi").dropDuplicates(["_key"]).drop("_key")
        kept = kept.unionByName(once)
    return kept
