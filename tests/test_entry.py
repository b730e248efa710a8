import __spark_entry__


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0


def test_core_does_not_need_the_subpackage():
    import pathlib

    root = pathlib.Path(__spark_entry__.__file__).parent / "lectern"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "lectern.llm" not in p.read_text()


def test_every_check_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
