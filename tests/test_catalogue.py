"""Every registered grid query against DuckDB on the smallest tables."""

import duckdb
import pytest

from tidewell.catalogue import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = ("events", "lineitem", "orders", "embeddings")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    made = con.sql(ORACLE_SQL[name])
    assert sorted(made.columns) == cols
    at = [made.columns.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in at) for r in made.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=2e-3) if all(isinstance(x, float) for x in a) else [x if not isinstance(x, float) else round(x, 2) for x in a] == [x if not isinstance(x, float) else round(x, 2) for x in b]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
