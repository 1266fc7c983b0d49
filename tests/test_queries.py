"""Every registered query of the engine against its SQL."""

import pytest

from quarry.plans import catalogue

from . import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connection(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    sql = catalogue.oracle_sql().get(name)
    assert sql is not None
    assert compare.difference(spark, duck, FOLDER, catalogue.queries()[name], sql) is None
