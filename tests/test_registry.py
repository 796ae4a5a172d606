"""Every registered query builds and agrees with its SQL in names; a few run beside DuckDB in full."""

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_oracle_keys_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["bm25_topk", "dense_topk", "derived_supersession", "resolved_citations", "lint_unverified", "windowed_actions", "graph_unmapped_types"])
def test_same_rows_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    got, want = [sorted((tuple(r) for r in rows), key=lambda r: [repr(v) for v in r if not isinstance(v, float)])
                 for rows in (df.select(*cols).collect(), cur.fetchall())]
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == pytest.approx(w, abs=2e-6)
