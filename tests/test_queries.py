"""Every registered query against its SQL on the small tables, and the contract of the entry module."""

import importlib.util
import sys
from pathlib import Path

import pytest
from compare import difference

from evigrid import registry

ENTRY = Path(__file__).resolve().parent.parent / "__spark_entry__.py"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, small, name):
    assert difference(spark, small, registry.queries()[name], registry.oracle_sql()[name]) == ""


def _entry():
    spec = importlib.util.spec_from_file_location("entry_module", ENTRY)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_entry(spark):
    module = _entry()
    assert module.entry(spark).count() > 0
    assert set(module.oracle_sql()) <= set(module.queries())


def test_entry_without_the_corpus_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    module = _entry()
    assert set(module.queries()) == set(registry.queries())
