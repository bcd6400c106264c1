"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as driver
from webcorpus.plans import oracle, queries as registered
from compare import difference, duck

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = driver.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(oracle.oracle_sql()) == set(registered.queries())


@pytest.mark.parametrize("name", SQL)
def test_query(spark, con, name):
    assert difference(spark, con, SF_DIR, name, SQL[name]) is None


def test_entry(spark):
    assert driver.entry(spark).columns == ["host", "page_links", "file_links"]
