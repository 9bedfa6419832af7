import pytest

from epiframe.plans import registry
from tests.oracle import check, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_an_oracle():
    assert registry.QUERIES.keys() == registry.ORACLES.keys()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_oracle(spark, con, sf, name):
    check(spark, con, registry.QUERIES[name], registry.ORACLES[name], sf)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 8
