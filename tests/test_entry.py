import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "target", "post_id", "repost_created_at", "text", "langs"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, entry.queries()[name], entry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert entry.queries()[name](spark, SF_DIR).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
