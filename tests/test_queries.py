"""Every registered query against its SQL twin, or at least run once, on the smallest data set."""

import os

import oracle
import pytest

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TWINS = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(FOLDER)


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1


def test_every_twin_belongs_to_a_query():
    assert set(TWINS) <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    build = queries()[name]
    if name not in TWINS:
        assert build(spark, FOLDER).limit(1).count() == 1
        return
    _, problems = oracle.compare(spark, duck, name, build, TWINS[name], FOLDER)
    assert not problems
