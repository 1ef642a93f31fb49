"""Driver contract: entry runs, every oracle has a query."""

import importlib


def test_entry_and_registry(spark):
    entry = importlib.import_module("__spark_entry__")
    df = entry.entry(spark)
    assert df.count() >= 1
    assert set(df.columns) == {"split", "n_pos", "n_neg", "auc", "gini"}
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60
