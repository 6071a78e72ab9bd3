"""The queries of the optional subpackage: against their SQL where there is one."""

import pytest
from conftest import SF

from riskweft.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, same, name):
    same(queries.queries()[name](spark, SF), SQL[name])


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 14)}
