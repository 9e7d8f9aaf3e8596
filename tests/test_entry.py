import importlib
import sys

import __spark_entry__


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["symbol", "open_time", "open", "high", "low", "close", "volume"]
    assert df.count() > 0


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    assert all(callable(q) for q in queries.values())


def test_works_without_the_corpus_operators(monkeypatch):
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    plain = importlib.import_module("__spark_entry__")
    names = plain.queries()
    assert "candles_1h" in names
    assert not [n for n in names if n.startswith("op") or n == "pipeline"]
