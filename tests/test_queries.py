"""Every registered query next to its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import difference, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, con, name):
    ours = queries()[name](spark, SF).toPandas()
    sql = oracle_sql().get(name)
    if sql is None:
        assert len(ours)
        return
    assert difference(ours, con.execute(sql).df()) is None


def test_entry(spark):
    rows = entry(spark).collect()
    assert sum(r["samples"] for r in rows) == 500
