import pytest

from quern import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_same_rows_as_sql(agrees, name):
    agrees(queries.queries()[name], SQL[name])


def test_entry_imports_and_names_match():
    import __spark_entry__ as e

    assert set(queries.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_works_without_the_training_data_folder():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['quern.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'word_count' in e.queries() and not [q for q in e.queries() if q.startswith('op') and q[2].isdigit()]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)


def test_flagship_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["word", "n"]
