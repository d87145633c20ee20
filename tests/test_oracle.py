"""Every registered query with SQL gives the same rows on DuckDB (smallest data)."""

import os

import pytest
from oracle import compare, database
from textvane.catalog.registry import catalog

FOLDER = os.environ.get("TEXTVANE_TESTDATA", "/root/testdata/sf0.001")
CATALOG = catalog()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", [n for n, e in CATALOG.items() if e.sql])
def test_rows_agree(spark, con, name):
    same, message = compare(spark, con, CATALOG[name].run, CATALOG[name].sql, FOLDER)
    assert same, message
