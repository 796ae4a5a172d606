"""Interaction logs as streams: tolerant ingest, running rates, windows, replays."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from specloom.operators.feedback import selected, shown
from specloom.sources.readers import INTERACTION, interaction_valid
from specloom.streaming.versions import latest, write_version


def stream_interactions(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of log lines with ``valid``; corrupt or inconsistent lines keep their text in ``value``."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    schema = T.StructType.fromDDL(INTERACTION + ", _corrupt_record STRING")
    lines = reader.load(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return parsed.select("value", "r.*").withColumn("valid", F.coalesce(interaction_valid(), F.lit(False))).drop("_corrupt_record")


def stream_acceptance(events: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """Keep (id, n_shown, n_accepted) current in a versioned table.

    Each batch is reduced to one row per record and merged into the newest version; a replayed batch
    rebuilds its own version from the one before it, so counts stay exact after a failure.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        s = shown(batch).groupBy("id").agg(F.count(F.lit(1)).alias("n_shown"))
        a = batch.select(selected().alias("id")).filter(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("n_accepted"))
        new = s.join(a, "id", "full").fillna(0)
        old = latest(batch.sparkSession, state, before=batch_id)
        both = new if old is None else old.select(*new.columns).unionByName(new)
        write_version(both.groupBy("id").agg(F.sum("n_shown").alias("n_shown"), F.sum("n_accepted").alias("n_accepted")), state, batch_id)

    return (events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def current_rates(spark: SparkSession, state: str) -> DataFrame:
    counts = latest(spark, state)
    return counts.filter("n_shown > 0").withColumn("rate", F.col("n_accepted") / F.col("n_shown"))


def windowed_actions(events: DataFrame, width: str, slide: str | None = None, lateness: str | None = None,
                     ts: str = "ts", action: str = "event_type") -> DataFrame:
    """(start, end, action, n, value) in tumbling or sliding windows, of a table or a stream.

    With a lateness, a stream drops older events; their number is the batch progress metric
    ``numRowsDroppedByWatermark`` (see :class:`LateRows`).
    """
    if lateness and events.isStreaming:
        events = events.withWatermark(ts, lateness)
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = events.groupBy(window.alias("w"), action).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), action, "n", "value")


def user_sessions(events: DataFrame, gap: str, lateness: str | None = None, ts: str = "ts", user: str = "user_id") -> DataFrame:
    """(user, start, end, n): runs of a user's events whose distance stays below the gap."""
    if lateness and events.isStreaming:
        events = events.withWatermark(ts, lateness)
    out = events.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class LateRows(StreamingQueryListener):
    """Counts the rows that queries drop for being later than their watermark, over all batches of a run.

    Register it before a query starts (``count_late``). It holds one number for each run; replayed batches that drop
    rows again count again, as in Spark's own progress.
    """

    def __init__(self) -> None:
        self._dropped: dict[str, int] = {}
        self._ended: dict[str, threading.Event] = {}

    def _end(self, run: str) -> threading.Event:
        return self._ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        self._end(str(event.runId))

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        late = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        self._dropped[run] = self._dropped.get(run, 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(str(event.runId)).set()

    def total(self, query: StreamingQuery, timeout: float = 60.0) -> int:
        """Rows dropped so far; of an ended query the final number, once all its reports have come in."""
        run = str(query.runId)
        if not query.isActive and not self._end(run).wait(timeout):
            raise TimeoutError(f"the reports of run {run} have not all come in")
        return self._dropped.get(run, 0)


def count_late(spark: SparkSession) -> LateRows:
    """A registered counter of late rows for every query started from now on."""
    counter = LateRows()
    spark.streams.addListener(counter)
    return counter


def dropped_late(query: StreamingQuery) -> int:
    """Late rows in the progress reports that Spark still holds (the last 100 by default); see :class:`LateRows` for all."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def dedupe_stream(events: DataFrame, key: str, lateness: str, ts: str = "ts") -> DataFrame:
    """Replayed events once; state for a key is dropped when the watermark has passed it."""
    if not events.isStreaming:
        return events.dropDuplicates([key])
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])
