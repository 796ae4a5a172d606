"""Ranked lexical search by dense blocked matrix products.

Scores are sums of weight x impact over an item's terms, so a block of items against a block of documents is one
matrix product. (1) One pass over the texts keeps of each document the terms that some item holds, as (number, count) arrays
of a compact vocabulary, and sums document frequencies, the number of documents and their terms. (2) Items are cut into
tiles, each with a vocabulary of its own terms alone, cut again into tiles of at most ``tile_terms`` columns. Each block of documents is
laid out as a dense tile of impacts over these columns and multiplied by BLAS in float64. (3) Each task keeps the best
``k`` documents of an item; a window over items merges the tasks.

Exactness: weights and impacts are integers and impacts are below 10^6. A tile takes columns while each item's weights in it sum to at
most ``BOUND``, so every partial sum of a product stays below 2^53 and is exact in any order of addition; products of
tiles are added as 64-bit integers. A weight above the bound (a term repeated many times in an item) becomes several columns.

Vocabularies travel as broadcasts, so items are dealt into groups of at most ``vocabulary`` distinct terms in sum (an
item with more is a group of its own) and each group takes a pass of its own over the documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specloom.llm.common import cut, release_memory, running_sum, slices

#: Impacts are below a million.
SCALE, TOP_IMPACT = 1_000_000_000, 1_000_000
BOUND = (2 ** 53 - 1) // TOP_IMPACT
#: Term characters are digits, letters and all bytes outside ASCII; the table maps A-Z to a-z and the others to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

POSTED = "kind int, doc_id long, n long, ids binary, tfs binary"


def terms(text: str | None) -> list[bytes]:
    """The maximal runs of term characters, A-Z lower-cased, in UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term binary, c): the distinct terms of each item; ``item`` numbers the rows of ``items``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                found = Counter(terms(b.column(2)[row].as_py()))
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[row].as_py()] * n, pa.int64()), pa.array([b.column(1)[row].as_py()] * n, pa.int64()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["item", "item_id", "term", "c"])

    return items.mapInArrow(run, "item long, item_id long, term binary, c long")


def item_groups(asked: DataFrame, most: int) -> tuple[DataFrame, int]:
    """(``asked`` with its ``group``, the number of groups): consecutive items whose distinct terms sum to about ``most``."""
    sizes = asked.groupBy("item").agg(F.count(F.lit(1)).alias("size"))
    placed = running_sum(sizes, [], ["item"], "size", "before")
    grouped = cut(placed.select("item", F.expr(f"before div {int(most)}").alias("group")))
    # the numbers may have gaps behind an item of many terms
    names = [r["group"] for r in grouped.select("group").distinct().orderBy("group").collect()]
    order = {g: i for i, g in enumerate(names)}
    if names and names[-1] != len(names) - 1:
        grouped = grouped.replace(order, subset=["group"])
    return cut(asked.join(grouped, "item")), len(names)


def posted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Kind 0: each document with a term, its number of terms ``n`` and the items' terms in it. Kind 1, one for each task: ids and
    document frequencies of the task's documents, with their number as ``doc_id`` and all their terms as ``n``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look_up = shared.value.get
        df = np.zeros(len(shared.value), np.int64)
        documents = total = 0
        for b in batches:
            lengths = b.column(2).to_pylist()
            for s in slices(lengths):
                rows = []
                for d, t in zip(b.column(0)[s.start:s.stop].to_pylist(), b.column(1)[s.start:s.stop]):
                    found = terms(t.as_py())
                    if not found:
                        continue
                    n = len(found)
                    documents, total = documents + 1, total + n
                    counts = Counter(map(look_up, found))
                    counts.pop(None, None)
                    ids = np.fromiter(counts.keys(), "<u4", len(counts))
                    df[ids] += 1
                    rows.append((d, n, ids.tobytes(), np.fromiter(counts.values(), "<i8", len(counts)).astype("<u4" if n < 1 << 32 else "<i8").tobytes()))
                if rows:
                    d, n, ids, tfs = zip(*rows)
                    yield record(0, d, n, ids, tfs)
        at = np.flatnonzero(df)
        if documents:
            yield record(1, [documents], [total], [at.astype("<u4").tobytes()], [df[at].astype("<i8").tobytes()])
        release_memory()

    def record(kind: int, d, n, ids, tfs) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(d), pa.int32()), pa.array(d, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(tfs, pa.binary())], names=["kind", "doc_id", "n", "ids", "tfs"])

    return docs.select("doc_id", "text", F.coalesce(F.length("text"), F.lit(0)).alias("size")).mapInArrow(run, POSTED)


def totals(table: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all their terms, document frequency of each vocabulary number)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, documents = np.zeros(size, np.int64), 0, 0
        for b in batches:
            for d, terms_, ids, tfs in zip(*(c.to_pylist() for c in b.columns)):
                documents, n = documents + d, n + terms_
                sums[np.frombuffer(ids, "<u4")] += np.frombuffer(tfs, "<i8")
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *at.tolist()], pa.int64()), pa.array([documents, n, *sums[at].tolist()], pa.int64())], names=["i", "v"])

    part = table.where("kind = 1").select("doc_id", "n", "ids", "tfs").mapInArrow(run, "i long, v long")
    got = {r["i"]: r["v"] for r in part.groupBy("i").agg(F.sum("v").alias("v")).collect()}  # a number for each term of the group
    df = np.zeros(size, np.int64)
    for i, v in got.items():
        if i >= 0:
            df[i] = v
    return got.get(-2, 0), got.get(-1, 0), df


class Tile:
    """Some items' weights over some columns (ascending vocabulary numbers); a number whose weight was split stands in several tiles."""

    def __init__(self, items: np.ndarray, columns: np.ndarray, weights: np.ndarray):
        self.items, self.columns, self.weights = items, columns, weights

    def add_scores(self, out: np.ndarray, row: np.ndarray, ids: np.ndarray, impact: np.ndarray) -> None:
        """Add this tile's part to ``out`` (documents x items)."""
        at = np.minimum(np.searchsorted(self.columns, ids), len(self.columns) - 1)
        live = self.columns[at] == ids
        dense = np.zeros((len(out), self.weights.shape[1]))
        dense[row[live], at[live]] = impact[live]
        out += (dense @ self.weights.T).astype(np.int64)


def item_tiles(weights: dict[int, dict[int, int]], tile_items: int, tile_terms: int, bound: int = BOUND) -> list[list[Tile]]:
    """For each tile of items its vocabulary tiles, which hold the whole weights between them. ``weights``: item to {vocabulary number:
    weight x repeats}. No item's weights in a tile sum to more than ``bound``, so that partial sums stay below 2^53."""
    out = []
    names = sorted(weights)
    for first in range(0, len(names), tile_items):
        items = np.array(names[first:first + tile_items])
        left: dict[int, dict[int, int]] = {}  # column to {row: weight}
        for row, item in enumerate(items.tolist()):
            for i, w in weights[item].items():
                if w > 0:
                    left.setdefault(i, {})[row] = w
        tiles = []
        while left:
            sums, columns, cells = np.zeros(len(items), np.int64), [], []
            for i in sorted(left):
                if len(columns) == tile_terms:
                    break
                part = {row: min(w, bound) for row, w in left[i].items()}
                if all(sums[row] + w <= bound for row, w in part.items()):
                    for row, w in part.items():
                        sums[row] += w
                    columns.append(i)
                    cells.append(part)
            matrix = np.zeros((len(items), len(columns)))
            for c, (i, part) in enumerate(zip(columns, cells)):
                for row, w in part.items():
                    matrix[row, c] = w
                rest = {row: w - bound for row, w in left[i].items() if w > bound}
                if rest:
                    left[i] = rest
                else:
                    del left[i]
            tiles.append(Tile(items, np.array(columns), matrix))
        if tiles:
            out.append(tiles)
    return out


NO_ID = np.iinfo(np.int64).max


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest positive scores, equal ones by id: all documents that tie with the k-th are compared, none is cut."""
    live = np.flatnonzero(scores > 0)
    if len(live) > k:
        least = np.partition(scores[live], len(live) - k)[len(live) - k]
        live = live[scores[live] >= least]
    order = np.lexsort((ids[live], -scores[live]))[:k]
    return scores[live][order], ids[live][order]


def scored(table: DataFrame, tiles: list[list[Tile]], documents: int, total: int, k: int, block: int) -> DataFrame:
    """(item, doc_id, score): the best ``k`` of each task for each item."""
    shared = table.sparkSession.sparkContext.broadcast(tiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for first in range(0, b.num_rows, block):
                part = b.slice(first, block)
                ids = [np.frombuffer(x, "<u4") for x in part.column(2).to_pylist()]
                tfs = [np.frombuffer(x, "<i8" if len(x) > 4 * len(i) else "<u4").astype(np.int64) for x, i in zip(part.column(3).to_pylist(), ids)]
                # Python integers: n x N of a very long document may pass 64 bits before the division
                m = np.array([25 + (75 * n * documents) // total for n in part.column(1).to_pylist()], np.int64)
                names = np.array([NO_ID if d is None else d for d in part.column(0).to_pylist()], np.int64)
                row = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
                ids, tf = np.concatenate(ids).astype(np.int64), np.concatenate(tfs)
                impact = (SCALE * tf) // (1000 * tf + 8 * m[row])
                for group in shared.value:
                    sums = np.zeros((part.num_rows, len(group[0].items)), np.int64)
                    for tile in group:
                        tile.add_scores(sums, row, ids, impact)
                    for j, item in enumerate(group[0].items.tolist()):
                        score, doc = best(sums[:, j], names, k)
                        if len(score) and item in kept:
                            score, doc = np.concatenate([kept[item][0], score]), np.concatenate([kept[item][1], doc])
                            score, doc = best(score, doc, k)
                        if len(score):
                            kept[item] = score, doc
        for item, (score, doc) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(doc), pa.int64()), pa.array(doc, pa.int64(), mask=doc == NO_ID), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])
        release_memory()

    return table.where("kind = 0").select("doc_id", "n", "ids", "tfs").mapInArrow(run, "item long, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", vocabulary: int = 50_000,
                   tile_items: int = 64, tile_terms: int = 4096, block: int = 512) -> DataFrame:
    """The ``k`` highest-scoring documents of each row of ``items``: item_id, rank (from 1), doc_id, score.

    Only scores above 0 count; equal scores rank by ascending doc_id, a null doc_id after all others. Null and empty texts have no terms: such an item
    has no rows, such a document counts nowhere. Rows that repeat a doc_id are documents of their own, rows that repeat an item_id (or have none) items
    of their own. An empty table gives no rows; extra columns are left out. Whole texts are read, of any length.
    """
    spark = docs.sparkSession
    numbered = cut(items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).withColumn("item", F.monotonically_increasing_id()))
    asked, groups = item_groups(cut(item_terms(numbered.select("item", "item_id", "text"))), vocabulary)
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = []
    for group in range(groups):
        own = asked.where(F.col("group") == group).select("item", "term", "c").collect()  # bounded by ``vocabulary`` or one item's text
        numbers = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in own}))}
        table = cut(posted(given, numbers))
        documents, total, df = totals(table, len(numbers))
        weights: dict[int, dict[int, int]] = {}
        for r in own:
            i = numbers[bytes(r["term"])]
            weights.setdefault(r["item"], {})[i] = r["c"] * weight(int(df[i]), documents)
        tiles = item_tiles(weights, tile_items, tile_terms)
        if total:
            found.append(cut(scored(table, tiles, documents, total, k, block)))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    top = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
