"""Every registered query against its SQL. SF_DIR picks the data."""
import os

import pytest

import oracle
from tickloom.plans import ORACLES, QUERIES

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    return oracle.connection(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem, _, _ = oracle.compare(spark, con, name, QUERIES[name], ORACLES.get(name), FOLDER)
    assert problem is None, problem


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
