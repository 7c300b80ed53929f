"""Every registered query with an SQL twin agrees with it on the smallest data folder."""

import pytest
from oracle import connect, differences

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_twin(spark, duck, name):
    assert differences(spark, duck, FOLDER, entry.queries()[name], entry.oracle_sql()[name]) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
