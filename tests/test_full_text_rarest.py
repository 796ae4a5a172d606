from specloom.operators import bm25 as B


def test_only_documents_with_the_rarest_word_meet_a_query(spark, monkeypatch):
    """200 documents share a word, one holds the rare one too: before, each of the 200 was joined with the query."""
    docs = spark.createDataFrame([(i, "common words here") for i in range(200)] + [(900, "common rare rare"), (901, "rare")], ["doc", "text"])
    queries = spark.createDataFrame([(1, "common rare"), (2, "common absent"), (3, "common"), (4, "")], ["q", "text"])
    index, met = B.build_bm25(docs, "doc", "text"), []
    join = B.salted_join

    def counted(big, small, *rest):
        out = join(big, small.filter("query < 3"), *rest)
        met.append(out.count())
        return join(big, small, *rest)

    monkeypatch.setattr(B, "salted_join", counted)
    got = [tuple(r) for r in B.full_text_search(queries, index, 3, "q", "text").orderBy("query", "rank").collect()]
    assert got == [(1, 900, 3, 1), (3, 0, 1, 1), (3, 1, 1, 2), (3, 2, 1, 3)] and met == [2]
