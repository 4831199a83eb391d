import importlib

import __spark_entry__ as entry


def test_every_sql_has_its_query():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and "p2_found" in q


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "n_sentences", "n_ai", "ai_sentence_share"] and df.count() > 0


def test_nothing_outside_needs_the_optional_subpackage():
    from pathlib import Path

    root = Path(importlib.import_module("ledgerloom").__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "ledgerloom.llm" not in f.read_text(), f
