import pytest

from harrow.plans.queries import SQL, Q

from .compare import spark_rows, sql_rows

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q))
def test_equals_sql(spark, name):
    assert spark_rows(Q[name](spark, DATA)) == sql_rows(SQL[name], DATA)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
