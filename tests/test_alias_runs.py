from specloom.operators import fusion


def test_phrases_meet_texts_by_equality_and_not_text_by_text(spark, monkeypatch):
    monkeypatch.setattr(fusion, "pattern_hits", None)
    long = "a b c d e f g h i"
    phrases = ["one two three", "two", "", " ", "two ", long, long + " j", "h i x", None]
    texts = {1: "zero One Two three", 2: "one twoo three", 3: "x  two  y", 4: long + " k", 5: "a b c d e f g h", 6: "", 7: None, 8: "a b c d e f g h " + long}
    aliases = spark.createDataFrame(list(enumerate(phrases)), "doc long, alias string")
    queries = spark.createDataFrame([*texts.items(), (1, "two")], "query long, text string")
    got = {(r["query"], r["doc"]) for r in fusion.alias_hits(queries, aliases).collect()}
    want = {(q, d) for q, t in texts.items() for d, p in enumerate(phrases) if t is not None and p and f" {p} " in f" {t.lower()} "}
    assert got == want and (4, 5) in want and (3, 4) in want and (5, 5) not in want
