"""Every registered query against its SQL, or at least against being empty, on the smallest tables."""

import pytest

from oracle import compare, connect
from penprint.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, FOLDER, name, QUERIES[name], ORACLES.get(name)) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
