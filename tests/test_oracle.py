"""Every registered query against its SQL on the test tables."""

import pytest
from compare import connect, difference
from conftest import SF_DIR

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, sf_dir, name):
    result = QUERIES[name](spark, sf_dir).toArrow()
    expected = con.sql(ORACLES[name]).to_arrow_table()
    assert expected.num_rows > 0, "a check on no rows checks nothing"
    assert difference(result, expected) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["user_id", "email_count", "last_mail"]
    assert df.count() > 0
