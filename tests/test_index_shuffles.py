"""The index upkeep brings only the texts of repeated documents together."""

from specloom.streaming import index


def test_only_repeated_documents_are_shuffled(spark, monkeypatch):
    rows = [(i, f"t{i}", False) for i in range(20)] + [(3, "a3", False), (3, "t3", False), (None, "x", False)]
    changes = spark.createDataFrame(rows, "doc long, text string, withdrawn boolean")
    met, first = [], index.first_per_group
    monkeypatch.setattr(index, "first_per_group", lambda df, *args: (met.append(df.count()), first(df, *args))[1])
    got = sorted((r.doc, r.text) for r in index._single(changes, ["doc", "text"]).collect())
    assert got == sorted([(i, f"t{i}") for i in range(20) if i != 3] + [(3, "a3")])
    assert met == [3]
