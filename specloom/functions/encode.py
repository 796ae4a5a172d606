"""Text to vector: a built-in hashing encoder and the plug-in surface for models."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specloom.functions.rows import repeats, token_slices
from specloom.functions.text import tokens


def hashing_encoder(df: DataFrame, key: str, text: str, dim: int = 64, variant: str = "alnum") -> DataFrame:
    """(key, vec): unit-length token counts hashed into ``dim`` buckets; all zeros for no tokens. A text is encoded in its row."""
    given = df.select(F.col(key).alias("key"), tokens(text, variant).alias("tokens"))
    if repeats(df, key):  # the tokens of all rows of a key are those of one text
        merged = given.filter(F.col("tokens").isNotNull()).groupBy("key").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
        given = given.select("key").join(merged, "key", "left")
    schema = T.StructType([df.schema[key], T.StructField("vec", T.ArrayType(T.DoubleType()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sizes in token_slices(batches):
            coded = part.column(1).flatten().dictionary_encode()
            buckets = np.array([int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % dim for w in coded.dictionary.to_pylist()], np.int64)
            places = np.repeat(np.arange(len(sizes)) * dim, sizes) + buckets[coded.indices.to_numpy()]
            counts = np.bincount(places, minlength=len(sizes) * dim).reshape(-1, dim).astype(np.float64)
            norm = np.sqrt((counts * counts).sum(1, keepdims=True))
            vecs = counts / np.where(norm > 0, norm, 1.0)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(np.arange(len(sizes) + 1, dtype=np.int32) * dim, vecs.ravel())], names=schema.names)

    return given.mapInArrow(encode, schema)


def encoder_udf(load_model: Callable[[], Callable[[list[str]], list]]) -> Callable[[Column], Column]:
    """Wrap a user model as an Arrow-batched column function; the model loads once per task."""

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for batch in batches:
            yield pd.Series([[float(x) for x in v] for v in model(batch.fillna("").tolist())])

    return encode


def pair_scorer_udf(load_model: Callable[[], Callable[[list[str], list[str]], list]]):
    """Wrap a user (query, document) scorer as an Arrow-batched column function."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load_model()
        for queries, docs in batches:
            yield pd.Series([float(x) for x in model(queries.fillna("").tolist(), docs.fillna("").tolist())])

    return score
