"""Every registered core query against DuckDB on the smallest tables."""

import os

import pytest

from skyledger import feed_queries, queries  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert got
    if name in queries.SQL:
        want = duck.sql(queries.SQL[name])
        assert sorted(want.columns) == columns
        assert got == sorted(map(repr, want.select(*[f'"{c}"' for c in columns]).fetchall()))


def test_entry_stands_without_the_text_operators(monkeypatch):
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(__spark_entry__.queries()) == set(queries.QUERIES) and set(__spark_entry__.oracle_sql()) == set(queries.SQL)
