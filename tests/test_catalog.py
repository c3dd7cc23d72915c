import pytest

from compare import check
from twinloom.plans import load_all

CATALOG = load_all()


@pytest.mark.parametrize("name", sorted(CATALOG.ORACLES))
def test_query_equals_oracle(spark, sf, name):
    check(CATALOG.QUERIES[name](spark, sf), CATALOG.ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(CATALOG.QUERIES) - set(CATALOG.ORACLES)))
def test_query_without_oracle_has_rows(spark, sf, name):
    assert CATALOG.QUERIES[name](spark, sf).count() > 0


def test_entry_points():
    import __spark_entry__ as e

    assert set(CATALOG.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_points_without_the_optional_part(monkeypatch):
    import importlib.util
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    spec = importlib.util.find_spec("__spark_entry__")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert "keep_view" in entry.queries() and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in entry.queries())
    assert set(entry.oracle_sql()) == set(CATALOG.ORACLES)
