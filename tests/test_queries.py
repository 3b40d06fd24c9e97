"""Every named query against its check on the smallest tables."""

import os

import pytest

import __spark_entry__ as driver
from check_queries import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    if not os.path.isdir(FOLDER):
        pytest.skip("test tables are not here")
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query_agrees_with_its_check(spark, engine, name):
    good, text = compare(spark, engine, FOLDER, name)
    assert good, text


def test_entry_has_a_stable_schema(spark):
    result = driver.entry(spark)
    assert result.columns == ["topic", "partitions", "brokers", "messages", "size", "size_text"]
    assert result.count() == 5


def test_every_check_belongs_to_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
