"""Every registered query against its SQL on the smallest test tables."""

import os

import pytest
from oracle import compare, database

from parley import catalog

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF_DIR)
    if name in catalog.SQL:
        assert compare(con, df, catalog.SQL[name]) is None
    else:
        assert df.count() > 0
