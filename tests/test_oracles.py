"""Every registered query with SQL gives the same rows as the SQL does, here on the smallest data."""

import pytest

import oracle
from tidemark import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLES:
        assert oracle.differences(df, con, registry.ORACLES[name]) == ""
    else:
        assert df.count() >= 1 or name == "e2_near_duplicates"


def test_flagship(spark):
    rows = registry.flagship(spark, SF).collect()
    assert {r.status for r in rows} <= {"pass", "partial", "fail"} and len(rows) == 5


def test_entry_without_text_operators(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def refuse(name, *args, **kwargs):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError("gone", name=name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", refuse)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(registry.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
    sys.modules.pop("__spark_entry__", None)
