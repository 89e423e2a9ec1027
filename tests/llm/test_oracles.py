"""The operators' queries against their SQL."""

import duckdb
import pytest

from intervale.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = db.sql(ORACLES[name])
    found = QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(want.columns)
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, found.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)
