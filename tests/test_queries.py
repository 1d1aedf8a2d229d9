"""Every registered query against its oracle SQL on the smallest tables."""

import pytest

from check import compare, oracle
from taufold.queries import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    assert compare(spark, con, SF, name) == ""
