"""The driver's entry with and without the optional part."""

import sys

import pytest

import __spark_entry__ as entry
from benchloom import registry


def _blocked(monkeypatch, *parts):
    for name in [n for n in sys.modules if any(n == p or n.startswith(f"{p}.") for p in entry.OPTIONAL)]:
        monkeypatch.delitem(sys.modules, name)
    for p in parts:
        monkeypatch.setitem(sys.modules, p, None)


@pytest.mark.parametrize("parts", [("benchloom.llm",), ("benchloom.llm", "corpus_pipeline")])
def test_without_the_optional_part(monkeypatch, parts):
    _blocked(monkeypatch, *parts)
    assert entry.queries().keys() == registry.QUERIES.keys() and entry.oracle_sql().keys() == registry.ORACLE_SQL.keys()


def test_other_missing_modules_raise(monkeypatch):
    monkeypatch.setattr(entry, "import_module", lambda name: (_ for _ in ()).throw(ModuleNotFoundError("no", name="numpy")))
    with pytest.raises(ModuleNotFoundError):
        entry.queries()


def test_flagship(spark):
    assert entry.entry(spark).count() == 4
