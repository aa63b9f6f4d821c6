import pytest

from tapeloom.plans import registry
from tests.conftest import SF
from tests.helpers import same

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    same(registry.queries()[name](spark, SF).toPandas(), duck.sql(SQL[name]).df())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(registry.queries())
