"""Every registered query against its SQL, over whole tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as contract
from gristmill.catalog import load

QUERIES = load().QUERIES
SQL = load().ORACLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries())
    assert set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, duck, sf_dir, name):
    assert compare(spark, duck, QUERIES[name], SQL[name], sf_dir) is None


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["doc_id", "lang", "source", "n_chars", "text_md5", "split"]
    assert df.count() > 0
