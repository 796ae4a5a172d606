"""Scans with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specloom.functions.scoring import valid_interaction

INTERACTION = ("query STRING, candidates_shown ARRAY<STRUCT<id: STRING, final_score: DOUBLE, rank: INT>>, chosen_id STRING, "
               "action STRING, corrected_id STRING, timestamp STRING, source STRING")
STANDARD = ("id STRING, number STRING, title STRING, scope STRING, description STRING, category STRING, version STRING, "
            "last_amended STRING, status STRING, keywords ARRAY<STRING>")
GOLD = "query STRING, expected_ids ARRAY<STRING>, query_type STRING"


def read_corpus(spark: SparkSession, path: str, schema: str = STANDARD, field: str = "standards") -> DataFrame:
    """Corpus JSON as a bare array or as an object that holds the array under ``field``."""
    nested = T.StructType.fromDDL(schema)
    wrapped = T.StructType([*nested.fields, T.StructField(field, T.ArrayType(nested))])
    raw = spark.read.schema(wrapped).option("multiLine", True).json(path)
    cols = [f.name for f in nested.fields]
    inner = raw.filter(F.col(field).isNotNull()).select(F.explode(field).alias("r")).select(*[F.col(f"r.{c}") for c in cols])
    bare = raw.filter(F.col(field).isNull()).select(*cols).dropna("all")
    return bare.unionByName(inner)


def interaction_valid() -> Column:
    return (F.col("_corrupt_record").isNull() & F.col("query").isNotNull() & F.col("candidates_shown").isNotNull()
            & F.col("timestamp").isNotNull() & F.coalesce(F.col("source").isin("synthetic", "live"), F.lit(False))
            & valid_interaction("action", "chosen_id", "corrected_id"))


def read_interactions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected lines): corrupt JSON and schema violations are set aside, not fatal."""
    schema = T.StructType.fromDDL(INTERACTION + ", _corrupt_record STRING")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    flat = parsed.select("value", "r.*").withColumn("_ok", F.coalesce(interaction_valid(), F.lit(False)))
    return flat.filter("_ok").drop("value", "_ok", "_corrupt_record"), flat.filter("NOT _ok").select("value")


def read_gold(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(queries, qrels) of a multi-label gold file; the query text is the key."""
    g = spark.read.schema(GOLD).json(path).filter(F.col("query").isNotNull())
    return (g.select("query", F.col("query").alias("text"), F.col("query_type").alias("kind")),
            g.select("query", F.explode("expected_ids").alias("doc")))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, text): one row per text file, named by the file; undecodable bytes are replaced."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.txt$", "")
    return raw.select(name.alias("item_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """Parquet scan; the projection and the filter reach the scan."""
    df = spark.read.parquet(path)
    df = df if where is None else df.filter(where)
    return df if columns is None else df.select(*columns)


def read_jdbc(spark: SparkSession, url: str, table: str, columns: list[str], key: str | None = None,
              bounds: tuple[int, int, int] | None = None, **options) -> DataFrame:
    """Table of a relational database, split by a numeric key into parallel range scans."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        low, high, parts = bounds
        reader = reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load().select(*columns)
