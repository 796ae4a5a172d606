from specloom.plans.views import containing


def test_passages_are_found_by_runs_hashed_word_by_word(spark, monkeypatch):
    from specloom.plans import views

    passages = {1: "b c d", 2: "a b c d e f g h i j k l", 3: "x y", 4: "zz", 5: "  b c d e ", 6: "", 7: None, 8: "c d\ne f", 9: "b c d e"}
    docs = {1: "ab c de f", 2: "q a b c d e f g h i j k lm", 3: "ax yz", 4: "nothing", 5: "x  b c d e z", 6: "", 7: None, 8: "c d\ne fg", 9: " b c d e"}
    asked, own = [], views.word_runs
    monkeypatch.setattr(views, "word_runs", lambda *a: asked.append(1) or own(*a))
    got = containing(spark.createDataFrame(list(passages.items()), "query long, text string"), spark.createDataFrame(list(docs.items()), "doc long, text string").coalesce(1))
    want = {(q, d) for q, x in passages.items() for d, y in docs.items() if x and x.strip() and y and x in y}
    assert {tuple(r) for r in got.collect()} == want and len(asked) == 2
