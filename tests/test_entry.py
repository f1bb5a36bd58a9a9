import sys


def test_entry_without_the_corpus_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "textquarry.llm", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) == set(entry.queries()) and "locate_many_dna" in entry.queries()
    sys.modules.pop("__spark_entry__")
