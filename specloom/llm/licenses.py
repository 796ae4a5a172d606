"""License scan by diagonal voting, in DataFrame functions only.

All word pairs of a text (k-grams with k = 2) are joined to the template positions that hold the same pair. A hit votes
for the diagonal (position in the text less position in the template). Diagonals that differ by a few words are
merged (words put in or left out shift the diagonal), and a merged span is verified: it must cover
enough of the template's k-grams, each counted once, and a short phrase all of them, that is, its words stand consecutively.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specloom.llm.common import row_key

#: Phrases whose every place counts, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Wordings of license notices, as their texts have them, with this library's labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license version 2 0": "mpl-2.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "creative commons attribution sharealike": "cc-by-sa",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SENTINEL = ""
#: A template table of up to so many word pairs is broadcast: some 10 MB.
BROADCAST_ROWS = 50_000
#: Pairs of two of these words stand in any English text; they are no evidence and a notice does not list them.
COMMON = frozenset("a an and any are at be by for from in is it may not of on or that the this to under was with you".split())


def license_text(text: Column) -> Column:
    """Words of the text with A-Z lower-cased, joined by single spaces: ASCII letters and digits, and all above ASCII.

    ``lower`` also changes letters above ASCII, which no template holds; texts with one of the two that it makes ASCII
    go through ``translate``.
    """
    text = F.coalesce(text, F.lit(""))
    odd = text.contains("\u0130") | text.contains("\u212a")
    low = F.when(odd, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))
    return F.trim(F.regexp_replace(low, SEPARATORS, " "))


def template_table(spark: SparkSession, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """(template, label, base, wanted, gram, at): a row for each word pair of each template."""
    rows = []
    for base, texts in ((True, PHRASES if phrases is None else phrases), (False, NOTICES if notices is None else notices)):
        for text, label in texts.items():
            words = text.split(" ")
            if len(words) < 2:
                raise ValueError("a template has two words at least")
            pairs = [(" ".join(words[i:i + 2]), i) for i in range(len(words) - 1) if base or not COMMON.issuperset(words[i:i + 2])]
            rows += [(text, label, base, len(pairs), gram, i) for gram, i in pairs]
    return spark.createDataFrame(rows, "template string, label string, base boolean, wanted int, gram string, at int")


def scan_hits(docs: DataFrame, templates: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, n_words, pos, template columns): all hits of word pairs, and for each row of ``docs`` one row with the
    sentinel gram. Pairs overlap: the pattern consumes one word's border and looks ahead over two words."""
    norm = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(doc_id, text).alias("key"), license_text(F.col(text)).alias("w"))
    pairs = norm.select("doc_id", "key", (F.col("w") == "").alias("none"), F.regexp_extract_all("w", F.lit("(?:^| )(?=([^ ]+ [^ ]+))"), F.lit(1)).alias("pairs"))
    sized = pairs.select("doc_id", "key", F.when(F.col("none"), 0).otherwise(F.size("pairs") + 1).cast("long").alias("n_words"), F.concat(F.array(F.lit(SENTINEL)), "pairs").alias("grams"))
    rows = sized.select("doc_id", "key", "n_words", F.posexplode("grams").alias("p", "gram"))
    mark = docs.sparkSession.createDataFrame([("", "", True, 0, SENTINEL, 0)], templates.schema)
    held = templates.unionByName(mark)
    # a local table has no size statistics, so its rows are counted; beyond the bound both sides are shuffled by gram
    held = F.broadcast(held) if templates.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else held
    return rows.join(held, "gram").select("doc_id", "key", "n_words", (F.col("p") - 1).cast("long").alias("pos"), "template", "label", "base", "wanted", "at")


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, least: float = 0.85, slack: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` lists what was verified (label, first word, last word, coverage). n_base counts every place of every
    base phrase; score is the best coverage of a template. Null and empty texts have no words and empty labels;
    repeated rows give repeated results; an empty table gives no rows; extra columns are left out.
    """
    templates = template_table(docs.sparkSession) if templates is None else templates
    hits = scan_hits(docs, templates, doc_id, text)
    by = ["doc_id", "key", "n_words", "template", "label", "base", "wanted"]
    diagonals = hits.withColumn("diagonal", F.col("pos") - F.col("at")).groupBy(*by, "diagonal").agg(
        F.count(F.lit(1)).alias("votes"), F.collect_set("at").alias("places"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    # a repeated row doubles its votes: the sentinel's count says how often the row is there
    rows_of = Window.partitionBy("doc_id", "key")
    diagonals = diagonals.withColumn("times", F.max(F.when(F.col("template") == "", F.col("votes"))).over(rows_of))
    # all hits of a diagonal stand within one template's length, so diagonals near each other are near in the text
    near = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    starts = F.col("diagonal") - F.lag("diagonal").over(near) > slack
    exact = F.col("base")  # each diagonal of a phrase is one place, so these are not merged
    spans = diagonals.withColumn("island", F.sum(F.when(exact | F.coalesce(starts, F.lit(True)), 1).otherwise(0)).over(near.rowsBetween(Window.unboundedPreceding, 0)))
    merged = spans.groupBy("doc_id", "key", "n_words", "template", "label", "base", "wanted", "times", "island").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("places")))).alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
    cover = F.least(F.lit(1.0), F.col("votes") / F.col("wanted"))
    good = merged.where((F.col("template") == "") | F.when(F.col("base"), F.col("votes") >= F.col("wanted")).otherwise(cover >= least))
    real, base = F.col("template") != "", (F.col("template") != "") & F.col("base")
    span = F.struct("label", F.col("first").alias("first_word"), F.col("last").alias("last_hit"), F.round(cover, 6).alias("coverage"))
    listed = lambda which: F.array_join(F.sort_array(F.collect_set(F.when(which, F.col("label")))), ",")
    out = good.groupBy("doc_id", "key", "n_words").agg(
        F.max("times").cast("int").alias("times"), F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        listed(base).alias("base_labels"), listed(real).alias("labels"), F.coalesce(F.max(F.when(real, cover)), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_set(F.when(real & ~F.col("base"), span))).alias("spans"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("_n")).drop("_n")
