"""Every query of the core library against its SQL."""

import pytest

from partflow.plans import registry
from tests.helpers import SF, check


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, name):
    check(registry.QUERIES[name], registry.SQL[name], spark)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_returns_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_module():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(registry.QUERIES) <= set(e.queries())
