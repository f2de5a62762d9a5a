import __spark_entry__ as entry


def test_entry_has_rows(spark, small):
    assert entry.entry(spark).count() > 0


def test_queries_and_sql_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_module_of_the_core_needs_the_subpackage(spark):
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "quern"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
