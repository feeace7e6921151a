"""Every registered query against its SQL on the small tables."""

import pytest

from spanloom.plans import catalog
from tests.check_queries import compare, open_tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return open_tables(SF)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, SF) is None


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
