"""WARC archives as a table of record chunks.

An archive is a Parquet table of rows (part, offset, record, chunk, last, data, sha1): the ``data`` of a part in the order of ``offset``
is a WARC/1.1 byte stream. A record is one row if it is small and otherwise one row for each ``chunk_bytes`` of payload; chunk 0 also has the record's
header, the last chunk the end of the record. ``sha1`` is the running digest of the payload up to the chunk's end, so each prefix of an
oversized record can be verified before the rest is there.

Payloads are cut in the JVM, on bytes; Python gets one chunk at a time with a running digest and never a whole record. Reading is the same: records of
one row are read where they lie; the rows of longer ones are dealt by record, sorted by chunk and streamed through one digest state. (A digest
takes its bytes in order, so a record's chunks pass through one task, one batch at a time.)

Of records with equal payloads one is a ``response`` with the payload, the others are ``revisit`` records of a header alone, which name it.
They are made from a narrow table of digests: only payloads that are stored pass through a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm.common import cut, release_memory, rows_a_batch, shared_path

ARCHIVE = "part int, offset long, record string, chunk long, last boolean, data binary, sha1 string"
SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
#: Payload bytes that a task hands over at once, and rows of the Arrow batches that it gets.
BATCH_BYTES, BATCH_ROWS = 16 << 20, 256


def base32(hex_digest: Column) -> Column:
    """A SHA-1 in hex as upper-case base32: five hex digits are four base32 digits."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for group in range(8):
        bits = F.conv(F.substring(hex_digest, 5 * group + 1, 5), 16, 10).cast("int")
        out += [F.substr(letters, F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def measured(pages: DataFrame, page_id: str, url: str, payload: str, least: int) -> DataFrame:
    """(page_id, url, digest, size, uid, small): each row's payload by its digest; ``small`` is the payload if it is too short for revisits."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).cast("long").alias("size"), F.when(F.octet_length(body) < least, body).alias("small"))
    return cut(rows.withColumn("uid", F.monotonically_increasing_id()))


def record_name(page_id: Column, uid: Column) -> Column:
    """The record's URN: the row's number tells rows of one page apart."""
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(":"), uid.cast("string"))


def plan_records(rows: DataFrame, pages: DataFrame, page_id: str, payload: str, least: int) -> DataFrame:
    """(record, url, digest, size, refers, body): a row for each record; ``body`` is null for revisits, ``refers`` for responses.

    Of equal payloads of ``least`` bytes or more the largest page_id (of rows that repeat it, one) is the response."""
    large = rows.where(F.col("size") >= least)
    first = F.max(F.struct(F.col("page_id").isNotNull().alias("named"), "page_id", "uid", "url")).alias("top")
    groups = cut(large.groupBy("digest", "size").agg(first, F.count(F.lit(1)).alias("many")))
    kept = groups.select("digest", "size", "many", F.col("top.page_id").alias("keep_id"), F.col("top.uid").alias("keep_uid"), F.col("top.url").alias("keep_url"))
    again = large.join(kept.where("many > 1"), ["digest", "size"]).where("uid <> keep_uid")
    revisits = again.select(record_name(F.col("page_id"), F.col("uid")).alias("record"), "url", "digest", "size", record_name(F.col("keep_id"), F.col("keep_uid")).alias("refers"), F.lit(None).cast("string").alias("body"))
    no = F.lit(None).cast("string").alias("refers")
    short = rows.where(F.col("size") < least).select(record_name(F.col("page_id"), F.col("uid")).alias("record"), "url", "digest", "size", no, F.col("small").alias("body"))
    body = F.coalesce(F.col(payload), F.lit(""))
    given = pages.select(F.col(page_id).cast("long").alias("p"), F.sha1(body.cast("binary")).alias("d"), body.alias("body"))
    held = kept.join(given, kept["keep_id"].eqNullSafe(given["p"]) & (kept["digest"] == given["d"]))
    held = held.select(record_name(F.col("keep_id"), F.col("keep_uid")).alias("record"), F.col("keep_url").alias("url"), "digest", "size", no, "body", "many")
    # a payload whose page stands in several rows comes once for each of them
    once = held.where("many > 1").groupBy("record", "url", "digest", "size", "refers").agg(F.first("body").alias("body"))
    return held.where("many = 1").drop("many").unionByName(once).unionByName(short).unionByName(revisits)


def head(record: str, url: str | None, digest: str, size: int, refers: str | None, date: str) -> bytes:
    """The record's header block, with the HTTP header of a response."""
    fields = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", f"<{record}>"), ("WARC-Date", date)]
    if url is not None:  # a line break or a control character would end the field
        fields.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else "".join(f"%{x:02X}" for x in c.encode()) for c in url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    block = b""
    if refers:
        fields += [("WARC-Refers-To", f"<{refers}>"), ("WARC-Profile", SAME)]
        length = 0
    else:
        block = HTTP.format(size).encode()
        fields.append(("Content-Type", "application/http; msgtype=response"))
        length = len(block) + size
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in fields], f"Content-Length: {length}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + END + block


def to_base32(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, chunk_bytes: int = 256 << 10, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write a record for each row of ``pages`` under ``path``.

    Null payloads are empty and, like empty ones, payloads of 0 bytes; records with equal payloads of at least ``least`` bytes are one response and
    revisits; shorter ones are all responses. Rows that repeat a page are records of their own; a null page_id is below all others; a null url leaves its field out; an
    empty table gives an empty archive; extra columns are left out."""
    pages = pages.select(*dict.fromkeys([page_id, url, payload]))
    rows = measured(pages, page_id, url, payload, least)
    records = plan_records(rows, pages, page_id, payload, least)
    raw = F.col("body").cast("binary")
    last = F.expr(f"CAST(greatest(0, (coalesce(octet_length(body), 0) - 1) div {int(chunk_bytes)}) AS INT)")
    chunks = records.select("record", "url", base32(F.col("digest")).alias("digest"), "size", "refers", "body", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    chunks = chunks.select("record", F.when(F.col("chunk") == 0, F.col("url")).alias("url"), "digest", "size", "refers", F.col("chunk").cast("long").alias("chunk"),
                           F.substring(raw, F.col("chunk") * F.lit(chunk_bytes) + 1, F.lit(chunk_bytes)).alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, offset, name, state, done = TaskContext.get().partitionId(), 0, None, None, 0
        for b in batches:
            out = []
            held = 0
            for i in range(b.num_rows):
                record, url, digest, size, refers, chunk, piece = (c[i].as_py() for c in b.columns)
                if record != name:
                    if chunk != 0:
                        raise ValueError(f"{record}: its first chunk has number {chunk}")
                    name, state, done = record, hashlib.sha1(), 0
                piece = piece or b""
                state.update(piece)
                done += len(piece)
                data = piece if chunk else head(record, url, digest, size, refers, date) + piece
                over = bool(refers) or done == size
                if over:
                    if not refers and to_base32(state) != digest:
                        raise ValueError(f"{record}: the payload does not have its digest")
                    data += END
                out.append((part, offset, record, chunk, over, data, digest if refers else to_base32(state)))
                offset += len(data)
                held += len(data)
                if held >= BATCH_BYTES:
                    yield table(out)
                    out, held = [], 0
            if out:
                yield table(out)
        release_memory()

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.string()]
        names = ["part", "offset", "record", "chunk", "last", "data", "sha1"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    with rows_a_batch(pages.sparkSession, BATCH_ROWS):
        chunks.mapInArrow(run, ARCHIVE).write.option("compression", "zstd").parquet(path)


def fields_of(data: bytes) -> tuple[dict[str, str], int]:
    """The named fields of a record that begins with ``data`` and where its block begins."""
    stop = data.find(END)
    lines = data[:max(stop, 0)].decode("utf-8").split("\r\n")
    if stop < 0 or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not the beginning of a WARC record")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}, stop + len(END)


class Reader:
    """Takes the chunks of one record after another, in order, and keeps no more than counts and a digest state."""

    def begin(self, data: bytes) -> bytes:
        """Read the header; what follows it in the first chunk."""
        self.fields, at = fields_of(data)
        self.revisit = self.fields["warc-type"] == "revisit"
        self.left = int(self.fields["content-length"])
        self.sha1, self.size = hashlib.sha1(), 0
        if not self.revisit:
            body = data.find(END, at)
            if body < 0:
                raise ValueError("a response without an HTTP header")
            self.left -= body + len(END) - at
            at = body + len(END)
        return data[at:]

    def take(self, data: bytes) -> None:
        """Payload, and behind it the end of the record."""
        body = data[:self.left] if len(data) > self.left else data
        self.sha1.update(body)
        self.size += len(body)
        self.left -= len(body)
        if len(body) < len(data) and data[len(body):] != END:
            raise ValueError("a record does not end where its length says")

    def row(self) -> tuple:
        told = self.fields["warc-payload-digest"].removeprefix("sha1:")
        if self.left:
            raise ValueError(f"{self.fields['warc-record-id']}: {self.left} bytes are missing")
        if not self.revisit and to_base32(self.sha1) != told:
            raise ValueError(f"{self.fields['warc-record-id']}: the payload does not have its digest")
        refers = self.fields.get("warc-refers-to")
        return (self.fields["warc-record-id"][1:-1], None if self.revisit else self.size, told, self.fields["warc-type"], refers[1:-1] if refers else None, self.fields.get("warc-target-uri"))


READ = "record string, payload_bytes long, payload_digest string, record_type string, refers string, url string"


def read_records(archive: DataFrame) -> DataFrame:
    """A row for each record of an archive table: record, payload_bytes (null for revisits), payload_digest, record_type, refers (the record that it
    names), url. Every payload is measured and digested again; a record that is cut short, has a chunk too few or another digest is an error."""
    def rows(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["record", "payload_bytes", "payload_digest", "record_type", "refers", "url"])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for b in batches:
            found = []
            for data in b.column(0):
                reader.take(reader.begin(data.as_py()))
                found.append(reader.row())
            if found:
                yield rows(found)
        release_memory()

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, name, due, over = Reader(), None, 0, True
        for b in batches:
            found = []
            for i in range(b.num_rows):
                record, chunk, last, data, sha1 = (c[i].as_py() for c in b.columns)
                if record != name:
                    if not over or chunk != 0:
                        raise ValueError(f"{name if not over else record}: a chunk is missing")
                    name, due = record, 0
                    data = reader.begin(data)
                if chunk != due:
                    raise ValueError(f"{record}: chunk {chunk} stands where {due} is due")
                reader.take(data)
                if to_base32(reader.sha1) != sha1:
                    raise ValueError(f"{record}: chunk {chunk} does not have its running digest")
                due, over = due + 1, last
                if last:
                    found.append(reader.row())
            if found:
                yield rows(found)
        if not over:
            raise ValueError(f"{name}: its last chunk is missing")
        release_memory()

    alone = archive.where("chunk = 0 AND last").select("data").mapInArrow(single, READ)
    longer = archive.where("NOT (chunk = 0 AND last)").select("record", "chunk", "last", "data", "sha1").repartition("record").sortWithinPartitions("record", "chunk")
    return alone.unionByName(longer.mapInArrow(streamed, READ))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Per record of the archive under ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to (the response's page_id). A revisit has
    the size of the response that it names; a revisit of a response that the archive lacks has none."""
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+):", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    with rows_a_batch(spark, BATCH_ROWS):
        records = cut(read_records(spark.read.schema(ARCHIVE).parquet(path)))
    again = records.where("record_type = 'revisit'")
    targets = records.where("record_type = 'response'").select(F.col("record").alias("refers"), F.col("payload_bytes").alias("full")).join(again.select("refers").distinct(), "refers", "left_semi")
    sized = again.join(targets, "refers", "left").withColumn("payload_bytes", F.col("full")).drop("full")
    every = records.where("record_type <> 'revisit'").unionByName(sized)
    return every.select(number("record").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers").alias("refers_to"))


def export_part(spark: SparkSession, path: str, part: int) -> Iterator[bytes]:
    """The WARC byte stream of one part, a chunk at a time, for a program that reads WARC files."""
    rows = spark.read.schema(ARCHIVE).parquet(path).where(F.col("part") == part).orderBy("offset").select("data")
    for r in rows.toLocalIterator():
        yield bytes(r["data"])


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the archive of ``pages`` into the shared folder and read it back."""
    path = shared_path(pages.sparkSession, "warc")
    write_archive(pages, path, **options)
    return read_archive(pages.sparkSession, path)
