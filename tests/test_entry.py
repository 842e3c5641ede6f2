import re

import __spark_entry__ as entry


def test_entry_has_rows(spark, sf):
    assert not entry.entry(spark).isEmpty()


def test_names_match():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert all(re.fullmatch(r"[a-z0-9_]+", n) for n in entry.queries())


def test_core_does_not_import_the_llm_subpackage():
    from pathlib import Path

    root = Path(entry.__file__).parent / "probelake"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "probelake.llm" not in p.read_text()
