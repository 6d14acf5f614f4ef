"""Every registered query against its SQL on the small tables."""

import pytest

from palisade.plans import catalog
from palisade.plans.check import compare, connect

from .conftest import SF


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, SF, catalog.QUERIES[name], catalog.ORACLE.get(name))
    assert ok is not False, note


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
