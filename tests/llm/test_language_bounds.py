"""The language stage rejects what it has not learned and keeps what it has."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from specloom.llm import langid

FOLDER = "/root/testdata/sf0.01/documents.parquet"
GREEK = "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση."
POLISH = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa."


@pytest.mark.parametrize("unlearned", [["es"], ["fr", "de", "es"]])
def test_texts_of_an_unlearned_language_go(spark, unlearned):
    docs = spark.read.parquet(FOLDER).withColumn("own", F.col("lang")).withColumn("lang", F.when(~F.col("lang").isin(unlearned), F.col("lang")))
    docs = docs.withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit("y"))  # clashing names stay as they are
    foreign = spark.createDataFrame([(-1, GREEK), (-2, POLISH), (-3, None), (-4, "12 34")], "doc_id long, text string")
    every = docs.unionByName(foreign, allowMissingColumns=True)
    kept = langid.keep_known_languages(every)
    assert kept.columns == every.columns
    rows = kept.collect()
    assert not {r.doc_id for r in rows} & {-1, -2, -3, -4}
    assert {(r.score, r.lang_pred) for r in rows} == {("x", "y")}
    learned = {r.doc_id for r in docs.where(F.col("text").rlike(r"\p{L}") & ~F.col("own").isin(unlearned)).collect()}
    others = {r.doc_id for r in docs.where(F.col("own").isin(unlearned)).collect()}
    stayed = {r.doc_id for r in rows}
    assert len(learned - stayed) <= len(learned) / 200
    assert len(others & stayed) <= len(others) / 20


def test_no_learned_document_goes(spark):
    docs = spark.read.parquet(FOLDER)
    kept = langid.keep_known_languages(docs)
    assert kept.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()


def test_bounds_by_hand():
    vectors = [(np.array([0, 1]), None), (np.array([1, 2]), None), (np.array([4]), None)]
    known = langid.known_bins(vectors, np.array([0, 0, 1]), 6, 3)
    assert known.tolist() == [True, True, True, False, True, False]
    counts = [(np.array([0, 3]), np.array([60, 40])), (np.array([1]), np.array([10]))]
    strange, least = langid.bounds_of(counts, known, np.array([0.9, 0.7]), np.array([0, 1]), 2)
    assert strange == pytest.approx(2 * (40 - langid.SPARE) / 100) and least == pytest.approx(0.6)
    assert langid.bounds_of([], known, np.zeros(0), np.zeros(0, int), 4) == (1.0, 0.25)
