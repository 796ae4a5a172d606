"""Token-id output: one frame per document, compressed with a shared zstandard dictionary.

Container: a Parquet table, because only Spark's writers reach every shared store and commit whole tasks.
Each row is one block of about ``block_ids`` ids:

* ``part``, ``seq``    place of the block: blocks in (part, seq) order hold the documents in ascending order
* ``dict_hash``        XXH64 of the dictionary that its frames need
* ``width``            bytes of an id (2 or 4, little-endian)
* ``doc_ids``, ``offsets``, ``n_tokens``, ``starts``   the offset index: document, first byte of its frame,
  ids in it, ids before it within the part. ``offsets`` has one more entry, the payload's length.
* ``payload``          the frames, one after another, each a zstandard frame of its own

A single document is read by decompressing ``payload[offsets[i]:offsets[i + 1]]`` alone. Beside the table
``blocks`` stand ``dictionary`` (hash, bytes) and ``parts`` (part, ids before it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specloom.llm.common import crc32, release_memory, shared_path, slices

BLOCK_SCHEMA = ("part int, seq int, dict_hash long, width int, doc_ids array<long>, offsets array<long>, "
                "n_tokens array<long>, starts array<long>, payload binary")
READ_SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long"


class Encoder:
    """Ids of whole texts by a ``tokenizers`` file, as little-endian arrays.

    For the byte-level pre-tokenizer no pre-token crosses the border before a space that a non-space
    follows, so a text is the sum of its first piece and its space-led pieces, and pieces may stand side by side in any order. The library cuts and encodes
    the pieces of a text that are not known yet, as one text; the ids of known pieces are looked up. A text with a space before other white
    space or at its end, or holding the string of an added token, goes to the library whole, as do all
    texts of other tokenizer kinds. At ``cache`` known pieces the table becomes the older one of
    two, whose pieces come back when they are met; the table before it goes. Pieces of over 64 characters are not kept.
    """

    def __init__(self, path: str, cache: int = 400_000):
        import json
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                         and not spec.get("normalizer") and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout"))
        tokens_added = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]
        self.by_piece = self.by_piece and not any(" " in t for t in tokens_added)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.added, self.gap = tokens_added, re.compile(r" \s").search
        self.cache, self.known, self.older = cache, {}, {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def unsafe(self, text: str) -> bool:
        return not self.by_piece or text.endswith(" ") or any(t in text for t in self.added) or self.gap(text) is not None

    def learn(self, pieces: set[str]) -> None:
        """Make all ``pieces`` known, each standing for itself behind a space."""
        if len(self.known) >= self.cache:
            self.known, self.older = {}, self.known
        older, new = self.older, []
        for p in pieces:
            ids = older.get(p)
            if ids is None:
                new.append(p)
            else:
                self.known[p] = ids
        if new:
            got = self.tokenizer.encode(" " + " ".join(new), add_special_tokens=False)
            ids = np.array(got.ids, self.dtype).tobytes()
            starts = np.array(got.offsets)[:, 0]
            sizes = np.fromiter(map(len, new), np.int64, len(new)) + 1
            # the first token of a piece begins at its space
            at = (np.searchsorted(starts, np.cumsum(sizes) - sizes) * self.dtype.itemsize).tolist()
            self.known.update((p, ids[i:j]) for p, i, j in zip(new, at, [*at[1:], len(ids)]))

    def encode(self, text: str) -> bytes:
        if self.unsafe(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        found = list(map(self.known.get, rest))
        if None in found:
            new = {p for p, ids in zip(rest, found) if ids is None}
            self.learn(new)
            look_up = self.known.__getitem__
            found = [look_up(p) if ids is None else ids for p, ids in zip(rest, found)]
            for p in new:
                if len(p) > 64:
                    del self.known[p]
        return self.whole(first) + b"".join(found)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file: made once in a Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str, text: str, samples: int, size: int) -> bytes:
    """A zstandard dictionary from at most ``samples`` documents (those with the smallest hashes), each
    of which gives its first 2,000 ids to the trainer. Only the compression rate depends on the
    sample, never a result. Too few samples to train on: the empty dictionary.
    """
    import zstandard

    draw = F.xxhash64(F.col(doc_id).cast("string"))
    total = docs.select(doc_id).count()
    some = docs.select(F.col(text).alias("t"), draw.alias("h"))
    if total > samples:  # a draw of about twice the number, so that the sort below is small
        some = some.where(F.pmod("h", F.lit(1 << 20)) < int(2 * samples / total * (1 << 20)) + 1)
    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        end = np.array([end_id], e.dtype).tobytes()
        for b in batches:
            out = []
            for t in b.column(0):
                out.append((e.encode(t.as_py() or "") + end)[:2000 * e.dtype.itemsize])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    chosen = some.orderBy("h", "t").limit(samples).select("t")
    arrays = [bytes(r["ids"]) for r in chosen.mapInArrow(ids, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(size, [a for a in arrays if len(a) >= 8]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def dictionary_hash(data: bytes) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(data)).astype(np.int64))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text",
                      block_ids: int = 1 << 20, samples: int = 2000, dict_size: int = 64 << 10, level: int = 3) -> None:
    """Encode every whole text, append ``end_id`` and write the container under ``path``.

    Null texts are empty; repeated rows are documents of their own; rows that share an id stand in the order of a hash of the text;
    null ids come first; extra columns are left out; an empty table gives an empty container. Documents
    are dealt by ranges of (id, hash of the text), so neither one frequent id nor one source fills a task.
    """
    spark = docs.sparkSession
    data = train_dictionary(docs, tokenizer, end_id, doc_id, text, samples, dict_size)
    mark = dictionary_hash(data)
    spark.createDataFrame([(mark, bytearray(data))], "dict_hash long, data binary").coalesce(1).write.parquet(f"{path}/dictionary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        e = encoder(tokenizer)
        end = np.array([end_id], e.dtype).tobytes()
        shared = zstandard.ZstdCompressionDict(data) if data else None
        compress = zstandard.ZstdCompressor(level=level, dict_data=shared).compress
        part, seq, start = 0, 0, 0
        ids, offsets, counts, starts, frames = [], [0], [], [], []

        def block() -> pa.RecordBatch:
            row = [[part], [seq], [mark], [e.dtype.itemsize], [ids], [offsets], [counts], [starts], [b"".join(frames)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 4, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=["part", "seq", "dict_hash", "width", "doc_ids", "offsets", "n_tokens", "starts", "payload"])

        for b in batches:
            lengths = b.column(1).to_pylist()
            for s in slices(lengths):
                take = b.slice(s.start, s.stop - s.start)
                part = take.column(3)[0].as_py()
                for d, t in zip(take.column(0).to_pylist(), take.column(2).to_pylist()):
                    raw = e.encode(t) + end
                    n = len(raw) // e.dtype.itemsize
                    frames.append(compress(raw))
                    ids.append(d)
                    counts.append(n)
                    starts.append(start)
                    offsets.append(offsets[-1] + len(frames[-1]))
                    start += n
                    if start - starts[0] >= block_ids:
                        yield block()
                        seq += 1
                        ids, offsets, counts, starts, frames = [], [0], [], [], []
        if ids:
            yield block()
        frames.clear()
        release_memory()

    ready = ordered.select("doc_id", F.length("text").alias("n"), "text", F.spark_partition_id().alias("part"))
    ready.mapInArrow(pack, BLOCK_SCHEMA).write.parquet(f"{path}/blocks")
    sizes = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").select("part", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each written part
    totals = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("long").alias("before")).write.parquet(f"{path}/parts")


def frame_ids(payload: bytes, begin: int, end: int, width: int, data: bytes) -> np.ndarray:
    """The ids of one document out of its block."""
    import zstandard

    shared = zstandard.ZstdCompressionDict(data) if data else None
    raw = zstandard.ZstdDecompressor(dict_data=shared).decompress(payload[begin:end])
    return np.frombuffer(raw, dtype="<u2" if width == 2 else "<u4")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Read a container back: doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of the ids
    as little-endian unsigned 32-bit integers). A frame is refused if its dictionary's hash is not that of the
    dictionary beside it, or its ids are not as many as the index says.
    """
    stored = spark.read.parquet(f"{path}/dictionary").first()
    data, mark = bytes(stored["data"]), stored["dict_hash"]
    if dictionary_hash(data) != mark:
        raise ValueError("the dictionary does not have the hash written beside it")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shared = zstandard.ZstdCompressionDict(data) if data else None
        decompress = zstandard.ZstdDecompressor(dict_data=shared).decompress
        for batch in batches:
            for i in range(batch.num_rows):
                part, _, named, width, ids, offsets, counts, starts, payload = (c[i].as_py() for c in batch.columns)
                if named != mark:
                    raise ValueError(f"block needs dictionary {named}, found {mark}")
                sums = []
                for k, n in enumerate(counts):
                    raw = decompress(payload[offsets[k]:offsets[k + 1]])
                    if len(raw) != n * width:
                        raise ValueError(f"document {ids[k]}: {len(raw)} bytes for {n} ids")
                    sums.append(crc32(np.frombuffer(raw, "<u2" if width == 2 else "<u4").astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    local = blocks.mapInArrow(unpack, READ_SCHEMA)
    parts = spark.read.schema("part int, before long").parquet(f"{path}/parts")
    return local.join(parts, "part").select("doc_id", (F.col("local_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_output(docs: DataFrame, tokenizer: str | None = None, **options) -> DataFrame:
    """Write the container into the shared folder and read it back."""
    path = shared_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer or tokenizer_path(), **options)
    return read_token_files(docs.sparkSession, path)
