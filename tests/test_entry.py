import importlib

entry = importlib.import_module("__spark_entry__")


def test_entry(spark):
    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
