"""Queries that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from ledgerbrook.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    found = c.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    df = QUERIES[name](spark, sf_dir)
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(str(dict(zip(names, r, strict=True))[k]) for k in sorted(names)) for r in found.fetchall())
    assert sorted(tuple(str(r[k]) for k in sorted(names)) for r in df.collect()) == want
