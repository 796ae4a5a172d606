"""Per-key throttle: at most ``limit`` accepted events in any trailing window; rejected ones do not count."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _decide(times: pd.Series, kept: deque, limit: int, window: float) -> list[bool]:
    out = []
    for now in times:
        while kept and kept[0] < now - window:
            kept.popleft()
        ok = len(kept) < limit
        if ok:
            kept.append(now)
        out.append(ok)
    return out


def throttle(events: DataFrame, key: str, seconds: str, order: str, limit: int = 60, window: int = 60) -> DataFrame:
    """Add ``allowed`` to a table; ``seconds`` is the event time in seconds, ``order`` breaks ties.

    A decision depends only on the key's events of the last ``window`` seconds. Time is cut into
    windows, and a run of consecutive non-empty ones (counted first, on one row per key and window)
    is independent of everything before it, so a busy key is spread over its runs. Inside a run the
    rows stream through the task in time order and only the last ``limit`` times are held.
    Events without a key share one limit; an event without a time can't be judged and has a NULL decision.
    """
    timed = events.filter(F.col(seconds).isNotNull())
    bucketed = timed.withColumn("_b", F.floor(F.col(seconds) / window))
    used = bucketed.select(key, "_b").distinct()
    runs = used.withColumn("_run", F.col("_b") - F.row_number().over(Window.partitionBy(key).orderBy("_b")))
    runs = runs.select(F.col(key).alias("_key"), F.col("_b").alias("_bucket"), "_run")
    placed = bucketed.join(runs, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_bucket"))).drop("_key", "_bucket")
    placed = placed.withColumn("_group", F.concat_ws("|", F.col(key).isNull().cast("string"), F.col(key).cast("string"), F.col("_run").cast("string")))
    placed = placed.repartition("_group").sortWithinPartitions("_group", seconds, order)
    schema = T.StructType([*events.schema.fields, T.StructField("allowed", T.BooleanType())])
    columns = events.columns

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, kept = None, deque()
        for batch in batches:
            allowed = pd.Series(False, index=batch.index)
            for run, rows in batch.groupby("_group", sort=False):
                if run != current:
                    current, kept = run, deque()
                allowed.loc[rows.index] = _decide(rows[seconds], kept, limit, window)
            yield batch[columns].assign(allowed=allowed)

    untimed = events.filter(F.col(seconds).isNull()).withColumn("allowed", F.lit(None).cast("boolean"))
    return placed.mapInPandas(decide, schema).unionByName(untimed)


def throttle_stream(events: DataFrame, key: str, ts: str, limit: int = 60, window: int = 60, lateness: str = "1 minute") -> DataFrame:
    """The same decision on a stream: (key, ts, allowed). A key's state is its accepted times of the last
    window, and it expires when the watermark is past them."""
    schema = T.StructType([events.schema[key], events.schema[ts], T.StructField("allowed", T.BooleanType())])

    def decide(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(batches)).sort_values(ts)  # one micro-batch of one key
        seconds = rows[ts].astype("int64") / 1e9 if rows[ts].dtype.name.startswith("datetime64[ns") else rows[ts].astype("datetime64[ns]").astype("int64") / 1e9
        allowed = _decide(seconds, kept, limit, window)
        state.update((list(kept),))
        if kept:
            horizon = int((kept[-1] + window) * 1000)
            state.setTimeoutTimestamp(max(horizon, state.getCurrentWatermarkMs() + 1))
        yield rows[[key, ts]].assign(allowed=allowed)

    return events.withWatermark(ts, lateness).groupBy(key).applyInPandasWithState(
        decide, schema, T.StructType([T.StructField("kept", T.ArrayType(T.DoubleType()))]), "append", GroupStateTimeout.EventTimeTimeout)
