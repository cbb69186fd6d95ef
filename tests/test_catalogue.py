"""Every catalogue query against its SQL; the others have to give rows."""

import pytest

import catalogue
import compare

QUERIES, ORACLES = catalogue.all_queries(), catalogue.all_oracles()


@pytest.fixture(scope="module")
def connection(sf_dir):
    return compare.duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, connection, name):
    ours = compare.spark_rows(QUERIES[name](spark, sf_dir))
    if name in ORACLES:
        assert compare.difference(ours, compare.duck_rows(connection, ORACLES[name])) is None
    assert ours[1]


def test_no_oracle_without_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
