"""The loss digest follows the written mask, and repeated events have a defined result."""

import hashlib

from pyspark.sql import functions as F

from specloom.llm import chat


def test_a_shifted_mask_changes_the_loss_digest(spark):
    rows = [(1, 0, "user", "a#b"), (1, 1, "assistant", "\\x </turn> y#"), (1, 2, "assistant", ""), (2, 0, "user", "only")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"at": F.lit(1), "loss_from": F.lit("x")})
    segments = chat.format_conversations(table)
    assert {r["conv_id"]: r["loss_sha256"] for r in chat.formatted_digests(segments).collect()} == {
        1: hashlib.sha256(rows[1][3].encode()).hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
    shifted = segments.withColumns({"loss_from": F.col("loss_from") - 1, "loss_to": F.col("loss_to") - 1})
    moved = {r["conv_id"]: r for r in chat.formatted_digests(shifted).collect()}
    assert moved[1]["loss_sha256"] != hashlib.sha256(rows[1][3].encode()).hexdigest() and moved[2]["loss_chars"] == 0


def test_repeated_events_count_as_often_as_they_stand(spark):
    log = [(1, 1, 1, "message", "user", "a"), (1, 1, 2, "delta", None, "b"), (1, 1, 2, "delta", None, "b")]
    events = spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string").withColumn("redone", F.lit(1))
    assert [r["text"] for r in chat.fold_events(events).collect()] == ["abb"]
    assert chat.fold_events(events.limit(0)).collect() == []
