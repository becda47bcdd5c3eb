"""Every registered query against its SQL, on the smallest driver tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import differences, oracle_connection

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, connection, name):
    assert differences(entry.queries()[name](spark, FOLDER), connection, SQL[name]) == []


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "seat_occupancy_rate" in df.columns
