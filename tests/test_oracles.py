import pytest

from tests.conftest import SMALL, rows_of, rows_of_spark
from tidemark.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    assert rows_of_spark(QUERIES[name](spark, SMALL)) == rows_of(duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_every_oracle_has_a_query():
    assert not set(ORACLES) - set(QUERIES)
