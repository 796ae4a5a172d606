"""A BM25 index kept up to date: a large base and small additions, so that a batch writes in proportion to itself.

Tables under ``path``; every batch writes one version of the first three, a merge also one of the others:

* ``added(doc, dl, terms)`` – the documents of the batch with their terms and counts; a withdrawn one has no ``dl`` and no terms;
* ``shift(term, df)`` – by how much the batch changes the document frequency of a term (signed);
* ``state`` – one row: documents and their length after the batch, the version of the base, additions since then. It is written
  last, so a batch without it does not count and is replayed;
* ``documents`` – the live documents of a base, in ``bucket`` folders by hash, so that a batch reads the folders it touches;
* ``postings``, ``vocabulary`` – the base as the search reads it.

A search reads the base's postings without the documents that later batches name, and the newest additions beside them.
When the additions pass a share of the base, both become the next base; so each row is rewritten about 1 / share times while the corpus doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from specloom.functions.text import tokens
from specloom.operators.bm25 import Bm25Index, weigh_terms
from specloom.operators.ranking import first_per_group
from specloom.session import cut_lineage
from specloom.streaming.versions import latest, write_version

TERMS = "array<struct<term: string, tf: bigint>>"


def _runs(words: Column) -> Column:
    """Counts of a sorted array's words, read off where each run starts (linear in its length)."""
    places = F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: (i < F.size(words)) & ((i == 0) | (F.get(words, i) != F.get(words, i - 1))))
    ends = F.concat(F.slice(places, 2, F.greatest(F.size(places), F.lit(1))), F.array(F.size(words)))
    runs = F.zip_with(places, ends, lambda a, b: F.struct(F.get(words, a).alias("term"), (b - a).cast("bigint").alias("tf")))
    return F.filter(runs, lambda r: r["tf"].isNotNull() & (r["tf"] > 0) & r["term"].isNotNull())


def counted_documents(docs: DataFrame, variant: str) -> DataFrame:
    """(doc, dl, terms) of ``docs(doc, text, withdrawn)``. A document without text is held, with no terms."""
    words = F.coalesce(F.array_sort(tokens("text", variant)), F.array().cast("array<string>"))
    sized = docs.select("doc", "withdrawn", words.alias("_words"))
    live = ~F.coalesce("withdrawn", F.lit(False))
    return sized.select("doc", F.when(live, F.size("_words").cast("bigint")).alias("dl"), F.when(live, _runs(F.col("_words"))).cast(TERMS).alias("terms"))


def _postings(docs: DataFrame) -> DataFrame:
    # the outer form keeps the optimizer from counting the terms again in an inferred filter
    return docs.filter("dl IS NOT NULL").select("doc", "dl", F.explode_outer("terms").alias("t")).filter("t IS NOT NULL").select(
        F.col("t.term").alias("term"), "doc", "dl", F.col("t.tf").alias("tf"))


def _since(spark: SparkSession, table: str, base: int, version: int) -> DataFrame:
    return spark.read.parquet(table).filter((F.col("version") > base) & (F.col("version") <= version))


def _newest(spark: SparkSession, path: str, base: int, version: int) -> DataFrame:
    """What the batches after ``base`` say last of each document they name."""
    said = _since(spark, f"{path}/added", base, version)
    last = said.groupBy("doc").agg(F.max_by(F.struct("dl", "terms"), "version").alias("r"))
    return last.select("doc", "r.dl", "r.terms")


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("doc"), F.lit(n)).cast("int")


def _base_documents(spark: SparkSession, path: str, state, doc_type: str) -> DataFrame:
    schema = f"doc {doc_type}, dl bigint, terms {TERMS}, bucket int"
    return spark.read.schema(schema).parquet(f"{path}/documents/version={state['base']}")


def _before_batch(spark: SparkSession, path: str, state, batch: DataFrame, doc_type: str) -> DataFrame:
    """(doc, dl, terms): what the index held of the batch's documents. Only their folders of the base are read."""
    named = batch.select("doc")
    later = _newest(spark, path, state["base"], state["version"]).join(named, "doc", "left_semi")
    base = _base_documents(spark, path, state, doc_type)
    touched = [r["b"] for r in batch.select(_bucket(state["buckets"]).alias("b")).distinct().collect()]  # one number a folder
    if len(touched) < state["buckets"]:
        base = base.filter(F.col("bucket").isin(touched))
    kept = base.select("doc", "dl", "terms").join(named, "doc", "left_semi").join(later.select("doc"), "doc", "left_anti")
    return cut_lineage(kept.unionByName(later).filter("dl IS NOT NULL"))


def _write_base(live: DataFrame, path: str, version: int, n: int, bucket_docs: int) -> int:
    """Write the three tables of a base; returns the number of its folders."""
    buckets = max(1, -(-n // bucket_docs))
    spark, doc_type = live.sparkSession, live.schema["doc"].dataType.simpleString()
    placed = live.select("doc", "dl", "terms", _bucket(buckets).alias("bucket"))
    placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/documents/version={version}")
    docs = _base_documents(spark, path, {"base": version}, doc_type)
    # by ranges of (term, doc): a reader prunes by term, and a word of all documents is still spread over tasks
    rows = _postings(docs).repartitionByRange("term", "doc").sortWithinPartitions("term", "doc")
    write_version(rows, f"{path}/postings", version)
    counts = spark.read.parquet(f"{path}/postings/version={version}").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    write_version(counts, f"{path}/vocabulary", version)
    return buckets


def _single(changes: DataFrame, order: list[str]) -> DataFrame:
    """The first row by ``order`` of each document. Only rows that share a document meet in a shuffle with their texts."""
    given = changes.filter("doc IS NOT NULL")
    again = cut_lineage(given.groupBy("doc").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("doc"))
    repeated = first_per_group(given.join(again, "doc", "left_semi"), ["doc"], order)
    return given.join(again, "doc", "left_anti").unionByName(repeated)


def _state(spark: SparkSession, path: str, before: int | None = None):
    rows = latest(spark, f"{path}/state", before)
    return None if rows is None else rows.first()


def apply_batch(changes: DataFrame, path: str, version: int, variant: str = "alnum", order: list[str] | None = None,
                share: float = 0.2, bucket_docs: int = 50_000) -> None:
    """Take ``changes(doc, text, withdrawn)`` into the index as batch ``version``; versions must grow, a replayed one overwrites itself.

    A document given again replaces what was held of it; ``withdrawn`` (NULL: false) removes it, also if it was never held. Of
    several rows of one document in a batch the first by ``order`` counts (by all columns where none is named). Rows without a
    ``doc`` are left out, NULL texts count as empty documents, further columns are ignored, and an empty batch changes nothing.
    """
    spark = changes.sparkSession
    doc_type = changes.schema["doc"].dataType.simpleString()
    state = _state(spark, path, before=version)
    single = _single(changes, order or changes.columns)
    write_version(counted_documents(single, variant), f"{path}/added", version)
    batch = spark.read.parquet(f"{path}/added/version={version}")
    held = batch.limit(0) if state is None else _before_batch(spark, path, state, batch, doc_type)
    moves = _postings(batch).select("term", F.lit(1).alias("d")).unionByName(_postings(held).select("term", F.lit(-1).alias("d")))
    shift = moves.groupBy("term").agg(F.sum("d").alias("df")).filter("df <> 0")
    write_version(shift, f"{path}/shift", version)

    sums = [F.count("dl").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length"), F.count(F.lit(1)).alias("rows")]
    new, old = batch.agg(*sums).first(), held.agg(*sums).first()
    n = new["n"] - old["n"] + (state["n"] if state else 0)
    length = new["length"] - old["length"] + (state["length"] if state else 0)
    added = new["rows"] + (state["added"] if state else 0)
    base, buckets = (state["base"], state["buckets"]) if state else (version, 1)
    if state is None or added > share * max(n, 1):
        live = batch.filter("dl IS NOT NULL")
        if state:
            said = _newest(spark, path, base, version)
            kept = _base_documents(spark, path, state, doc_type).select("doc", "dl", "terms").join(said.select("doc"), "doc", "left_anti")
            live = kept.unionByName(said.filter("dl IS NOT NULL"))
        buckets, base, added = _write_base(live, path, version, n, bucket_docs), version, 0
    row = spark.range(1).select(*[F.lit(v).cast("bigint").alias(k) for k, v in (
        ("version", version), ("n", n), ("length", length), ("base", base), ("buckets", buckets), ("added", added))])
    write_version(row, f"{path}/state", version)


def read_index(spark: SparkSession, path: str, variant: str = "alnum", before: int | None = None) -> Bm25Index:
    """The index as of the newest complete batch (below ``before``), for every search of ``operators.bm25``."""
    state = _state(spark, path, before)
    if state is None:
        raise ValueError(f"no index under {path}")
    base, version = state["base"], state["version"]
    said = cut_lineage(_newest(spark, path, base, version))
    old = spark.read.parquet(f"{path}/postings/version={base}").join(said.select("doc"), "doc", "left_anti")
    postings = old.select("term", "doc", "dl", "tf").unionByName(_postings(said))
    counts = spark.read.parquet(f"{path}/vocabulary/version={base}").unionByName(_since(spark, f"{path}/shift", base, version).select("term", "df"))
    counts = counts.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
    totals = spark.range(1).select(F.lit(state["n"]).cast("bigint").alias("n"), (F.lit(state["length"]) / F.lit(max(state["n"], 1))).alias("avgdl"))
    return Bm25Index(postings, cut_lineage(weigh_terms(counts, totals)), totals, variant)


def drop_merged(spark: SparkSession, path: str) -> int:
    """Delete what the newest base has taken in (earlier additions and bases); call when no search reads an earlier version."""
    state = _state(spark, path)
    gone = 0
    for table in ("added", "shift", "documents", "postings", "vocabulary") if state else ():
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{table}")
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(folder):
            number = status.getPath().getName().removeprefix("version=")
            # the base's own additions stay, so that these tables are never without a version
            if number.isdigit() and int(number) < state["base"]:
                gone += bool(fs.delete(status.getPath(), True))
    return gone


def stream_index(changes: DataFrame, path: str, checkpoint: str, variant: str = "alnum", **options) -> StreamingQuery:
    """Keep the index under ``path`` up to date with a stream of ``(doc, text, withdrawn)``."""
    def run(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch, path, batch_id, variant, **options)

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
