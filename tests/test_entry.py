"""The entry module stands without the optional subpackage or what that needs."""

from __future__ import annotations

import builtins
import importlib
import sys

import pytest

import __spark_entry__ as entry
from stockline.plans import catalog


@pytest.mark.parametrize("missing", ["public_tokenizers", "stockline.llm.pipeline", "stockline.llm.queries"])
def test_a_missing_import_costs_the_optional_queries_only(monkeypatch, missing):
    for name in [n for n in sys.modules if n.startswith("stockline.llm") or n in ("corpus_pipeline", "public_tokenizers")]:
        monkeypatch.delitem(sys.modules, name)
    load = builtins.__import__
    by_name = importlib.import_module

    def refuse(name, globals=None, locals=None, names=(), level=0):
        if name == missing or missing in [f"{name}.{n}" for n in names or ()]:
            raise ModuleNotFoundError(f"No module named {name!r}")
        return load(name, globals, locals, names, level)

    monkeypatch.setattr(builtins, "__import__", refuse)
    monkeypatch.setattr(importlib, "import_module", lambda name, *a: refuse(name) if name == missing else by_name(name, *a))
    with pytest.warns(UserWarning, match="training-data queries left out"):
        assert set(entry.queries()) == set(catalog.queries())
    with pytest.warns(UserWarning):
        assert set(entry.oracle_sql()) == set(catalog.queries())


def test_a_fault_that_is_no_import_error_is_not_hidden(monkeypatch):
    def broken(name, *args):
        raise ValueError("fault")

    monkeypatch.setattr(importlib, "import_module", broken)
    with pytest.raises(ValueError, match="fault"):
        entry.queries()
