import os

import pytest
from oracle import compare, connect

from __spark_entry__ import LLM_QUERIES, entry, oracle_sql, queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - set(LLM_QUERIES)))
def test_query_matches_sql(spark, con, name):
    compare(spark, con, name, queries()[name], oracle_sql()[name], FOLDER)


def test_every_query_has_sql():
    assert set(queries()) - set(LLM_QUERIES) == set(oracle_sql()) - set(LLM_QUERIES)


def test_entry(spark):
    assert entry(spark).columns == ["seq", "code", "detail", "id"]
