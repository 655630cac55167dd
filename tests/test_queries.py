import pytest

import __spark_entry__ as entry
from oracle import compare, connect
from yomibon.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    compare(con, spark, sf_dir, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["base", "total", "n_readings", "share", "flagged", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
