"""Every registered query of the reference part against its SQL oracle, on the smallest tables."""

import pytest
from compare import assert_same, connect

from strataq import catalog

ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, spark, sf_dir, duck):
    from strataq.session import ship

    assert_same(catalog.queries()[name](ship(spark), sf_dir), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLES)))
def test_without_oracle(name, spark, sf_dir):
    first = catalog.queries()[name](spark, sf_dir)
    again = catalog.queries()[name](spark, sf_dir)
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect()))
