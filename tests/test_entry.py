import __spark_entry__ as entry


def test_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert entry.entry(spark).count() == 15


def test_core_does_not_import_the_corpus_operators():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "tracklens"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "llm" not in f.read_text(), f
