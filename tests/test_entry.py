"""The driver's entry points."""

import __spark_entry__ as entry


def test_entry_and_names(spark):
    found, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(found) and len(found) >= 71
    assert entry.entry(spark).count() > 0
