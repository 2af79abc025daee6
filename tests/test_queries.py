import pytest

import __spark_entry__ as entry
from quillet import queries
from tests.oracle import rows, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert rows(df) == sql_rows(queries.ORACLE[name], SF)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_filter_pushes_down(spark, capsys):
    entry.entry(spark).explain()
    plan = capsys.readouterr().out
    assert "GreaterThan(l_quantity,45.0)" in plan and "Not(EqualNullSafe(l_returnflag,N))" in plan
    assert "l_shipdate" not in plan.split("ReadSchema")[1]
