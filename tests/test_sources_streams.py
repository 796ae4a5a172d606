import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from specloom.operators import feedback as B
from specloom.operators import relational as R
from specloom.sources import html, readers, writers
from specloom.streaming import interactions as I
from specloom.streaming.throttle import throttle, throttle_stream


def standard(i):
    return {"id": f"S{i}", "number": f"IS {i}", "title": "t", "keywords": ["k"]}


def test_corpus_as_array_or_object(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([standard(1), standard(2)]))
    (tmp_path / "b.json").write_text(json.dumps({"standards": [standard(3)], "_meta": {"n": 1}}))
    assert {r.id for r in readers.read_corpus(spark, str(tmp_path)).collect()} == {"S1", "S2", "S3"}


def test_documents_with_bad_bytes(spark, tmp_path):
    (tmp_path / "gov.in.is.1.2000.txt").write_bytes(b"ok \xff end")
    r = readers.read_documents(spark, str(tmp_path)).first()
    assert (r.item_id, r.text) == ("gov.in.is.1.2000", "ok � end")


def log(**kw):
    return {"query": "q", "candidates_shown": [{"id": "a", "final_score": 1.0, "rank": 1}], "chosen_id": "a", "action": "accept",
            "corrected_id": None, "timestamp": "2024-01-01", "source": "live", **kw}


def test_tolerant_log_scan_and_rates(spark, tmp_path):
    rows = [log(), log(chosen_id=" "), log(action="correct", corrected_id="b"), log(action="guess"), log(source="x"), log(action="reject", chosen_id=None)]
    (tmp_path / "l.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + "\n{broken\n\n")
    good, bad = readers.read_interactions(spark, str(tmp_path))
    assert (good.count(), bad.count()) == (3, 4)
    rates = {r.id: (r.n_shown, r.n_accepted) for r in B.acceptance_rate(good).collect()}
    assert rates == {"a": (3, 1)}
    stream = I.stream_interactions(spark, str(tmp_path))
    q = stream.writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT valid FROM seen").groupBy("valid").count().count() == 2 and spark.table("seen").filter("valid").count() == 3


def test_gold_and_links(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text(json.dumps({"query": "q1", "expected_ids": ["a", "b"], "query_type": "x"}) + "\n")
    queries, rel = readers.read_gold(spark, str(tmp_path))
    assert (queries.count(), rel.count()) == (1, 2)
    page = "<a href='details/gov.in.is.9.2000.'>x</a><a href='details/GOV.in.is.9.2000'>y</a>"
    links = html.extract_links(spark.createDataFrame([(1, page)], ["k", "h"]), "k", "h", r"(?i)details/(gov\.in\.is\.[\d.]+)")
    assert [r.item for r in links.collect()] == ["gov.in.is.9.2000"]


def test_sinks_and_upsert(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], ["id", "v", "w"])
    up = spark.createDataFrame([(2, "B", "y"), (3, "C", "y")], ["id", "v", "w"])
    out = str(tmp_path / "t")
    writers.overwrite_table(R.upsert(df, up, ["id"], ["v"]), out)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, "a", "x"), (2, "B", "x"), (3, "C", "y")]
    assert R.insert_new(df, up, ["id"]).count() == 3
    log_path = str(tmp_path / "l")
    writers.append_json(df, log_path)
    writers.append_json(df, log_path)
    assert spark.read.json(log_path).count() == 4


def test_remap_refuses_unknown_ids(spark):
    old, new = spark.createDataFrame([("o1", 1), ("o2", 2)], ["id", "k"]), spark.createDataFrame([("n1", 1)], ["id", "k"])
    df = spark.createDataFrame([("o1",)], ["ref"])
    assert R.remap_ids(df, "ref", old, new, "k").first().ref == "n1"
    with pytest.raises(Exception, match="no counterpart"):
        R.remap_ids(spark.createDataFrame([("o2",)], ["ref"]), "ref", old, new, "k").collect()


def model_throttle(events, limit, window):
    kept, out = {}, {}
    for i, key, t in sorted(events, key=lambda e: (e[2], e[0])):
        q = kept.setdefault(key, deque())
        while q and q[0] < t - window:
            q.popleft()
        out[i] = len(q) < limit
        if out[i]:
            q.append(t)
    return out


def test_throttle_matches_model(spark):
    rng = random.Random(9)
    events = [(i, "hot" if rng.random() < 0.5 else f"k{rng.randint(0, 5)}", float(rng.randint(0, 3000))) for i in range(1500)]
    got = throttle(spark.createDataFrame(events, ["id", "key", "sec"]), "key", "sec", "id", limit=3, window=60)
    assert {r.id: r.allowed for r in got.collect()} == model_throttle(events, 3, 60)


def test_throttle_stream_equals_batch(spark, tmp_path):
    events = [(i, f"k{i % 3}", 1_000_000 + i * 7 % 400) for i in range(200)]
    events.sort(key=lambda e: e[2])
    src = str(tmp_path / "in")
    df = spark.createDataFrame(events, ["id", "key", "sec"]).withColumn("ts", F.timestamp_seconds("sec"))
    df.coalesce(1).write.parquet(src)
    stream = throttle_stream(spark.readStream.schema(df.schema).parquet(src), "key", "ts", 4, 60)
    q = stream.writeStream.format("memory").queryName("throttled").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    want = model_throttle([(i, k, float(s)) for i, k, s in events], 4, 60)
    assert spark.table("throttled").count() == 200
    assert spark.table("throttled").filter("allowed").count() == sum(want.values())


def test_late_events_are_dropped_and_counted(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "ts TIMESTAMP, event_type STRING, value DOUBLE"
    for i, sec in enumerate([10, 7200, 7300, 20]):  # the last file arrives two hours late
        spark.createDataFrame([(sec,)], ["s"]).select(F.timestamp_seconds("s").alias("ts"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value")).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = I.windowed_actions(stream, "10 minutes", lateness="5 minutes")
    q = out.writeStream.format("memory").queryName("late").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert I.dropped_late(q) == 1


def test_late_rows_are_counted_over_all_batches(spark, tmp_path):
    src, key = str(tmp_path / "in"), "spark.sql.streaming.numRecentProgressUpdates"
    for i, sec in enumerate([7200, 7300, 20, 30, 7400, 7500, 40, 7600, 7700]):
        row = spark.createDataFrame([(sec,)], ["s"]).select(F.timestamp_seconds("s").alias("ts"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"))
        row.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("ts TIMESTAMP, event_type STRING, value DOUBLE").option("maxFilesPerTrigger", 1).parquet(src)
    counter = I.count_late(spark)
    spark.conf.set(key, "1")
    try:
        out = I.windowed_actions(stream, "10 minutes", lateness="5 minutes")
        q = out.writeStream.format("memory").queryName("late_all").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert counter.total(q) == 3 > I.dropped_late(q)
    finally:
        spark.conf.unset(key)
        spark.streams.removeListener(counter)


def test_splits_keep_groups_whole(spark):
    df = spark.range(300).selectExpr("id % 23 AS q", "id")
    folds = B.kfold(df, "q", 4, 1)
    assert folds.groupBy("q").agg(F.countDistinct("fold").alias("n")).filter("n > 1").isEmpty()
    sizes = [r.n for r in folds.groupBy("fold").agg(F.countDistinct("q").alias("n")).collect()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 23


def test_throttle_returns_every_row(spark):
    rows = [(1, None, 0.0), (2, None, 1.0), (3, None, 2.0), (4, "a", None), (5, "a", 1.0), (6, None, None)]
    got = throttle(spark.createDataFrame(rows, "id long, key string, sec double"), "key", "sec", "id", limit=2, window=60)
    assert {r["id"]: r["allowed"] for r in got.collect()} == {1: True, 2: True, 3: False, 4: None, 5: True, 6: None}
