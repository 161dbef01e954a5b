import os

import pytest

import __spark_entry__ as entry


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100


@pytest.mark.skipif(not os.path.isdir(entry.SMOKE_DIR), reason="needs the test tables")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"vehicle", "date", "shift", "km"} <= set(df.columns)


def test_without_the_text_operators(monkeypatch):
    monkeypatch.setattr(entry, "find_spec", lambda name: None)
    assert "shift_features" in entry.queries() and not any(n.startswith("op1_") or n == "pipeline" for n in entry.queries())
