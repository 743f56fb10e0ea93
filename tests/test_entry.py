"""The driver's contract."""

import __spark_entry__ as entry


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and all(map(callable, queries.values()))
    df = entry.entry(spark)
    assert df.columns == ["event_id", "user_id", "event_type", "value"] and df.count() > 0
