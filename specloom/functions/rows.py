"""Tokens of rows, worked on where the rows are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens that a task works on at once (a longer row is a slice of its own).
SLICE_TOKENS = 500_000


def token_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of ``batches`` of (anything, tokens) with the number of tokens of each row; null tokens are none."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy().astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_TOKENS)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(sizes)]):
            if b > a:
                yield batch.slice(a, b - a), sizes[a:b]


def repeats(df: DataFrame, key: str) -> bool:
    """Whether rows share a key."""
    return not df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty()
