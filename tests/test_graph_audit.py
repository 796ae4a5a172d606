import random

import pytest
from pyspark.sql import functions as F

from specloom.operators import audit as A
from specloom.operators import corpus as C
from specloom.operators import graph as G


def bfs(seeds, steps, hops):
    seen, layer, out = set(seeds), [(s, [s]) for s in seeds], {}
    for hop in range(1, hops + 1):
        best = {}
        for node, path in layer:
            for nxt, role in steps.get(node, []):
                if nxt not in seen:
                    cand = (path + [nxt], role)
                    best[nxt] = min(best.get(nxt, cand), cand)
        seen |= set(best)
        out.update({n: (hop, ">".join(p), r) for n, (p, r) in best.items()})
        layer = [(n, p) for n, (p, _) in best.items()]
    return out


def test_expand_matches_breadth_first_search(spark):
    rng = random.Random(2)
    kinds = ["NORMATIVE_REFERENCE", "TEST_METHOD_FOR", "RELATED_PRODUCT", "SUPERSEDED_BY", "ODD"]
    edges = {(f"n{rng.randint(0, 30)}", f"n{rng.randint(0, 30)}", rng.choice(kinds)) for _ in range(90)}
    steps = {}
    for s, t, k in edges:
        role = "RELATED_UNCLASSIFIED" if k == "ODD" else k
        if k in ("NORMATIVE_REFERENCE", "RELATED_PRODUCT", "ODD"):
            steps.setdefault(s, []).append((t, role))
        if k in ("TEST_METHOD_FOR", "RELATED_PRODUCT", "ODD"):
            steps.setdefault(t, []).append((s, role))
    seeds = [("r1", "n0"), ("r1", "n5"), ("r2", "n7")]
    got = G.expand(spark.createDataFrame(seeds, ["request", "node"]), G.orient(spark.createDataFrame(sorted(edges), ["source_id", "target_id", "type"])), 3)
    rows = {(r.request, r.node): (r.hop, ">".join(r.path), r.role) for r in got.collect()}
    want = {("r1", n): v for n, v in bfs(["n0", "n5"], steps, 3).items()} | {("r2", n): v for n, v in bfs(["n7"], steps, 3).items()}
    assert rows == want


def test_chain_branches_cycles_and_unknown(spark):
    std = spark.createDataFrame([("a", "superseded"), ("b", "withdrawn"), ("c", "active"), ("d", "active"), ("e", "superseded")], ["id", "status"])
    suc = spark.createDataFrame([("a", "b"), ("a", "d"), ("b", "a"), ("b", "c"), ("b", "ghost"), ("e", "e")], ["id", "successor"])
    chain = G.resolve_chain(std, suc)
    got = {(r.start, r.node, r.hop, r.state) for r in chain.filter("start IN ('a', 'e', 'c')").collect()}
    assert got == {("a", "b", 1, "passed"), ("a", "d", 1, "active"), ("a", "c", 2, "active"), ("a", "ghost", 2, "unknown"), ("c", "c", 0, "active")}
    assert {r.id: r.current for r in G.first_active(chain).collect()} == {"a": "d", "b": "c", "c": "c", "d": "d"}


def reached(status, successors):
    """Breadth-first ways by hand: {(start, node): hop}."""
    out = {}
    for start in (n for n, s in status.items() if s != "active"):
        seen, layer, hop = {start}, [start], 0
        while layer:
            hop += 1
            fresh = sorted({b for a in layer if status.get(a, "active") != "active" for b in successors.get(a, [])} - seen)
            out.update({(start, n): hop for n in fresh})
            seen |= set(fresh)
            layer = fresh
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chain_equals_breadth_first_on_cyclic_graphs(spark, seed):
    rng = random.Random(seed)
    status = {f"n{i}": rng.choice(["active", "superseded", "superseded", "withdrawn", "withdrawn"]) for i in range(60)}
    pairs = [(f"n{rng.randint(0, 59)}", f"n{rng.randint(0, 65)}") for _ in range(85)]  # some are not held, some repeat
    ways = {}
    for a, b in pairs:
        ways.setdefault(a, []).append(b)
    got = G.resolve_chain(spark.createDataFrame(list(status.items()), ["id", "status"]), spark.createDataFrame(pairs + pairs[:5], ["id", "successor"]))
    rows = [(r.start, r.node, r.hop) for r in got.filter("hop > 0").collect()]
    want = reached(status, ways)
    assert len(rows) == len(want) and {(a, b): h for a, b, h in rows} == want


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds, cut = [], G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    n = 1000
    std = spark.range(n).select(F.concat(F.lit("e"), "id").alias("id"), F.when(F.col("id") == n - 1, "active").otherwise("superseded").alias("status"))
    suc = spark.range(n - 1).select(F.concat(F.lit("e"), "id").alias("id"), F.concat(F.lit("e"), F.col("id") + 1).alias("successor"))
    chain = G.resolve_chain(std, suc)
    assert len(rounds) <= 12
    assert chain.count() == n * (n - 1) // 2 + 1
    assert chain.filter("hop != cast(substr(node, 2) as int) - cast(substr(start, 2) as int)").count() == 0
    assert G.first_active(chain).filter("current = 'e999'").count() == n


def test_ego_network_depth_two(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("c", "d", "x"), ("a", "c", "x"), ("d", "e", "x")], ["source_id", "target_id", "type"])
    nodes, kept = G.ego_network(spark.createDataFrame([("r", "a")], ["request", "node"]), edges, 2)
    assert {(r.node, r.hop) for r in nodes.collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert kept.count() == 4


def corpus(spark):
    rows = [("old", "IS 10:1990", 1990, "superseded", "curated", None, None, None, None), ("new", "IS 10:2001", 2001, "active", None, "ISI", True, None, "Q1"),
            ("p1", "IS 20 (Part 1)", 2000, "active", None, None, None, True, None), ("p2", "IS 20 (Part 2)", 2005, "active", None, None, None, None, None)]
    return spark.createDataFrame(rows, "id STRING, number STRING, edition_year INT, status STRING, supersession_source STRING, scheme STRING, mandatory BOOLEAN, qco_checked BOOLEAN, order_id STRING")


def resolved(spark, text):
    from specloom.functions.numbers import extract_citations
    docs = spark.createDataFrame([("d", text)], ["doc", "text"])
    return docs, A.resolve_citations(extract_citations(docs, "doc", "text"), corpus(spark))


def test_citation_resolution(spark):
    _, r = resolved(spark, "IS 10:1990 IS 10 IS 10:1977 IS 20 IS 20 (Part 1) IS 20 (Part 9) IS 99")
    got = [x.standard_id for x in r.orderBy("pos").collect()]
    assert got == ["old", "new", "new", "p2", "p1", None, None]


def test_lint_rules(spark):
    docs, _ = resolved(spark, "Supply IS 10:1990 bars.\nAlso IS 10:2001 and IS 77.\n- copper cable drum")
    edges = spark.createDataFrame([("new", "p2", "NORMATIVE_REFERENCE"), ("new", "old", "NORMATIVE_REFERENCE")], ["source_id", "target_id", "type"])
    orders = spark.createDataFrame([("Q1", "Order One")], ["order_id", "order_name"])
    chain = G.resolve_chain(corpus(spark).select("id", "status"), spark.createDataFrame([("old", "new")], ["id", "successor"]))
    hits = spark.createDataFrame([("copper cable drum", "p1", 0.6)], ["item", "standard_id", "similarity"])
    f = A.lint(docs, corpus(spark), edges, orders, chain, hits, ["NORMATIVE_REFERENCE"], 0.45)
    got = {(r.rule_id, r.severity, r.standard_id) for r in f.collect()}
    assert got == {("unresolved_citation", "medium", None), ("superseded_citation", "high", "old"), ("missing_allied_standard", "medium", "p2"),
                   ("missing_certification_requirement", "high", "new"), ("certification_unverified", "low", None), ("uncited_item", "medium", "p1")}
    s = A.finding_summary(f).first()
    assert (s.high, s.medium, s.low, s.total) == (2, 3, 1, 6)
    marked = docs.withColumn("text", F.concat("text", F.lit(" with ISI mark")))
    f2 = A.lint(marked, corpus(spark), edges, orders, chain, None, ["NORMATIVE_REFERENCE"], 0.45)
    assert f2.filter("rule_id = 'missing_certification_requirement'").isEmpty()


def test_capped_list(spark):
    df = spark.createDataFrame([("d", f"v{i}") for i in range(8)] * 2, ["doc", "v"])
    assert A.capped_list(df, "doc", "v", 6, "l").first().l == "v0, v1, v2, v3, v4, v5, and 2 more"


def test_consolidate_keeps_keywords_after_the_winner(spark):
    rows = [("s1", 1, "IS 1 ( part 1 ) : 2000", "t1", "short", "", "A", None, ["x"]), ("s2", 2, "IS 1 (Part 1):2000", "t2", "longer text", "", "A", None, ["y"]),
            ("s3", 3, "IS  1 (PART 1):2000", "t3", "s", "", "A", None, ["x", "z"])]
    df = spark.createDataFrame(rows, "source STRING, ordinal INT, number STRING, title STRING, scope STRING, description STRING, category STRING, status STRING, keywords ARRAY<STRING>")
    good, bad = C.consolidate(df, spark.createDataFrame([("a", "cat_a", "CA")], ["value", "canonical", "prefix"]))
    r = good.first()
    assert (r.title, r.keywords, r.sources, r.id, bad.count()) == ("t2", ["y", "x", "z"], ["s1", "s2", "s3"], "IS-CA-001", 0)


def test_review_last_row_wins_and_newest_is_refused(spark):
    std = spark.createDataFrame([("a", "IS 50", 1990), ("b", "IS 50", 2000), ("c", "IS 60", 1999)], ["id", "number", "edition_year"])
    null = F.lit(None).cast("string")
    std = std.withColumn("status", F.lit("active")).withColumn("superseded_by", null).withColumn("supersession_source", null)
    rows = [(1, "IS 50 : 1990", "x", "IS 60 : 1999"), (2, "IS 50 : 1990", "y", "--"), (3, "IS 50 : 2000", "x", ""), (4, "IS 50", "x", ""), (5, "IS 60", "x", "IS 50"), (6, "IS 70", "x", "")]
    df = spark.createDataFrame(rows, ["ordinal", "number", "category", "superseded_by"])
    assert [r.outcome for r in C.review_outcomes(std, df).orderBy("ordinal").collect()] == ["applied", "applied", "refused", "ambiguous", "applied", "unmatched"]
    out = {r.id: (r.status, r.superseded_by) for r in C.apply_review(std, df).collect()}
    assert out == {"a": ("withdrawn", "c"), "b": ("active", None), "c": ("superseded", "b")}


def test_guards(spark, tmp_path):
    df = spark.createDataFrame([(1, True), (2, None)], ["id", "verified"])
    with pytest.raises(ValueError):
        C.guard_unverified(df, production=True)
    assert C.guard_unverified(df, production=False) is df
    out = str(tmp_path / "t")
    assert not C.write_if_valid(df, df, out, write=True) and not C.write_if_valid(df, df.limit(0), out)
    assert C.write_if_valid(df, df.limit(0), out, write=True) and spark.read.parquet(out).count() == 2


def test_only_cited_needs_are_joined(spark, monkeypatch):
    """Records that no document cites need nothing, so mentions meet only the needs of cited ones; met needs are left out."""
    written, cut = [], A.cut_lineage
    monkeypatch.setattr(A, "cut_lineage", lambda df: (out := cut(df), written.append((out.columns, out.count())))[0])
    cites = spark.createDataFrame([("d1", "a", 0, 4, "IS 1"), ("d1", "b", 9, 13, "IS 2"), ("d1", "a", 20, 24, "IS 1"), ("d2", "a", 3, 7, "IS 1"), ("d3", None, 0, 4, "IS 9")],
                                  "doc STRING, standard_id STRING, start INT, end INT, raw STRING")
    edges = [("a", "b", "R"), ("a", "c", "R"), ("b", "c", "X")] + [(f"n{i}", "c", "R") for i in range(50)]
    std = spark.createDataFrame([(x, f"IS {x}") for x in "abc"], ["id", "number"])
    got = A.lint_missing_allied(cites, spark.createDataFrame(edges, ["source_id", "target_id", "type"]), std, ["R"])
    assert sorted((r.doc, r.start, r.evidence, r.standard_id) for r in got.collect()) == [("d1", 0, "IS 1", "c"), ("d2", 3, "IS 1", "b"), ("d2", 3, "IS 1", "c")]
    assert [n for c, n in written if "needed" in c] == [2]


def test_a_mark_in_the_text_moves_no_span(spark):
    from specloom.functions.numbers import extract_citations
    text = "\x01 IS 10:1990\x01IS 20 \x02" + "IS 30, " * 40
    rows = extract_citations(spark.createDataFrame([(1, text), (2, None), (3, "")], ["doc", "text"]), "doc", "text").orderBy("pos").collect()
    assert len(rows) == 42 and all(text[r.start:r.end] == r.raw and r.doc == 1 for r in rows)
