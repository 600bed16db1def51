import importlib
import sys

import __spark_entry__ as entry


def test_registry():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and "gap_report" in q and "p4_found" in q


def test_without_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "biblioflow.llm.queries", None)
    m = importlib.reload(entry)
    assert "gap_report" in m.queries() and not any(x.startswith("p9") for x in m.queries())
    monkeypatch.undo()
    importlib.reload(entry)
