"""Every named query against its SQL twin on the smallest tables."""

import os

import pytest
from conftest import SF_DIR
from oracle_check import compare, connect

import __spark_entry__ as contract
from corpusloom import catalogue

QUERIES, ORACLES = catalogue.all_queries(), catalogue.all_oracles()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables are not here")
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, message, _ = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert ok, message


def test_entry(spark, sf_dir):
    frame = contract.entry(spark)
    assert frame.columns == ["doc_id", "term", "rank", "tfidf"]
    assert frame.limit(5).count() == 5
