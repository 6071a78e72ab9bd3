"""Every registered query outside the optional subpackage against its SQL, and the others for their rows."""

import __spark_entry__ as entry
import pytest
from conftest import SF

from riskweft.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, same, name):
    same(registry.queries()[name](spark, SF), SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_gives_rows(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.count() > 0 and len(df.columns) > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["txn_id", "risk_score", "risk_level", "decision"]


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
