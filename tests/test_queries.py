"""Every registered query of the core library: against DuckDB where it has SQL, else for rows."""

import duckdb
import pytest

from intervale.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def normal(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (2, "0.00000" if abs(v) < 1e-9 else f"{v:.5f}")
    return (1, str(v))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, db, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = db.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    places = [want.columns.index(c) for c in columns]
    rows = want.fetchall()
    assert sorted(tuple(normal(r[c]) for c in columns) for r in found.collect()) == sorted(tuple(normal(r[i]) for i in places) for r in rows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
