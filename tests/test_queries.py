"""Every query runs; those with SQL give its rows."""

import pytest
from compare import database, spark_rows, sql_rows

from corpusloom import plans

QUERIES, SQL = plans.all_queries(), plans.all_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_dir, db, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == sql_rows(db, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
