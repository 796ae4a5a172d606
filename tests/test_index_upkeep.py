"""The maintained index against one rebuilt from the documents that live."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from specloom.operators.bm25 import bm25_search, build_bm25
from specloom.session import new_path
from specloom.streaming import index as X

SCHEMA = "doc bigint, text string, withdrawn boolean, seq int, note string"
WORDS = "alpha beta gamma delta cement steel beam the of and pipe valve 456 1987".split()


def rows(ix):
    return (sorted((r.term, r.doc, r.dl, r.tf) for r in ix.postings.collect()),
            {r.term: (r.df, round(r.idf, 9)) for r in ix.terms.collect()}, tuple(round(v, 9) for v in ix.totals.first()))


def rebuilt(spark, live):
    return build_bm25(spark.createDataFrame(sorted(live.items()), "doc bigint, text string"), "doc", "text")


def same(spark, path, live, before=None):
    kept, fresh = X.read_index(spark, path, before=before), rebuilt(spark, live)
    assert rows(kept) == rows(fresh)
    q = spark.createDataFrame([(1, "cement beam"), (2, "the pipe 1987 1987"), (3, "absent")], "query int, text string")
    hits = [sorted((r.query, r.rank, r.doc, round(r.score, 9)) for r in bm25_search(q, ix, 4, "query", "text").collect()) for ix in (kept, fresh)]
    assert hits[0] == hits[1] and hits[0]


def text(rng):
    return None if rng.random() < 0.1 else " ".join(rng.choices(WORDS, k=rng.randint(0, 9)))


def test_index_after_batches_equals_rebuilt_one(spark):
    rng, path, live, bases = random.Random(7), new_path(spark, "index"), {}, set()
    batches = [[(d, text(rng), False, 0, "x") for d in range(60)],
               [(3, "cement beam", None, 1, "x"), (4, "old words", False, 2, "x"), (4, "the the pipe", False, 1, "x"), (900, "never held", True, 1, "x"), (None, "no key", False, 1, "x")],
               [(d, None, True, 0, "x") for d in (3, 5, 6)], [],
               [(3, "beam once more", False, 0, "x"), (5, "", False, 0, "x"), (70, "a new one 456", False, 0, "x")],
               [(d, text(rng), rng.random() < 0.3, 0, "x") for d in range(0, 100, 4)]]
    for number, batch in enumerate(batches):
        X.apply_batch(spark.createDataFrame(batch, SCHEMA), path, number, order=["seq", "text"], share=0.2, bucket_docs=16)
        for d, words, withdrawn, _, _ in sorted((r for r in batch if r[0] is not None), key=lambda r: -r[3]):
            live.pop(d, None) if withdrawn else live.__setitem__(d, words)
        bases.add(X._state(spark, path)["base"])
        if number in (1, 3, 4, 5):
            same(spark, path, live)
    assert bases == {0, 5}  # the additions passed their share once
    # a replay of the last batch finds what stood before it, and leaves the same
    X.apply_batch(spark.createDataFrame(batches[5], SCHEMA), path, 5, order=["seq", "text"], share=0.2, bucket_docs=16)
    same(spark, path, live)
    assert X.drop_merged(spark, path) > 0
    X.apply_batch(spark.createDataFrame([(1, "after the merge", False, 0, "x")], SCHEMA), path, 6, order=["seq", "text"], share=0.2, bucket_docs=16)
    same(spark, path, live | {1: "after the merge"})


def size(folder):
    return sum(f.stat().st_size for f in Path(folder).rglob("*.parquet"))


def test_a_batch_writes_and_reads_in_proportion_to_itself(spark):
    path = new_path(spark, "index")
    words = F.concat_ws(" ", *[F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(500))) for i in range(40)])
    docs = spark.range(4000).select(F.col("id").alias("doc"), words.alias("text"), F.lit(False).alias("withdrawn"))
    X.apply_batch(docs, path, 0, bucket_docs=100)
    X.apply_batch(docs.filter("doc < 5").withColumn("text", F.lit("w1 fresh")), path, 1)
    wrote = sum(size(f"{path}/{t}/version=1") for t in ("added", "shift", "state"))
    assert wrote < size(f"{path}/postings/version=0") / 20 and not Path(f"{path}/postings/version=1").exists()
    state = X._state(spark, path)
    assert (state["n"], state["buckets"], state["added"], state["base"]) == (4000, 40, 5, 0)
    batch = spark.read.parquet(f"{path}/added/version=1")
    used = batch.select(X._bucket(40).alias("b")).distinct().count()
    read = X._base_documents(spark, path, state, "bigint").filter(F.col("bucket").isin([r.b for r in batch.select(X._bucket(40).alias("b")).collect()]))
    assert len(read.inputFiles()) == 40 and read.select(F.input_file_name()).distinct().count() == used <= 5


def test_stream_of_documents(spark):
    source, path = new_path(spark, "docs"), new_path(spark, "index")
    first, second = {1: "steel beam", 2: "cement", 3: "the valve"}, {2: "cement pipe"}
    for part in (first, second):
        spark.createDataFrame([(d, w, False) for d, w in part.items()], "doc bigint, text string, withdrawn boolean").coalesce(1).write.mode("append").json(source)
    stream = spark.readStream.schema("doc bigint, text string, withdrawn boolean").option("maxFilesPerTrigger", 1).json(source)
    X.stream_index(stream, path, new_path(spark, "offsets")).awaitTermination()
    same(spark, path, first | second)


def test_an_index_of_nothing(spark):
    path = new_path(spark, "index")
    X.apply_batch(spark.createDataFrame([], SCHEMA), path, 0)
    ix = X.read_index(spark, path)
    assert ix.postings.count() == 0 and ix.terms.count() == 0 and ix.totals.first().n == 0
    X.apply_batch(spark.createDataFrame([(1, "steel", False, 0, "x"), (2, "beam", False, 0, "x"), (3, "pipe 1987 cement", False, 0, "x")], SCHEMA), path, 1)
    same(spark, path, {1: "steel", 2: "beam", 3: "pipe 1987 cement"})
