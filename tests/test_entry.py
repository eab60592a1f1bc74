"""The record queries stand without the training-text package, or what it needs."""

import builtins
import sys

import pytest


@pytest.mark.parametrize("hidden", ["public_tokenizers", "harrow.llm", "corpus_pipeline", "numpy"])
def test_queries_without(monkeypatch, hidden):
    import __spark_entry__ as e

    from harrow.plans.queries import Q

    real = builtins.__import__

    def without(name, *args, **more):
        if name == hidden or name.startswith(hidden + "."):
            raise ImportError(name)
        return real(name, *args, **more)

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("harrow.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", without)
    assert set(Q) <= set(e.queries()) and "pipeline" not in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())
