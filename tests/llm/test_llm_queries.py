import pytest

from quern.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(agrees, name):
    agrees(queries.queries()[name], queries.oracle_sql()[name])


def test_every_operator_has_a_query():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.queries()) == list(range(1, 14))


def test_native_operators_plan_no_python(spark):
    from conftest import DATA

    for n in (1, 6, 7, 9):
        name = next(q for q in queries.queries() if q.startswith(f"op{n}_"))
        plan = queries.queries()[name](spark, str(DATA))._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow")), name
