"""Each query against its SQL counterpart, over whole tables."""

import pytest

from spindrift import plans

QUERIES, SQL = plans.collect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, small, duck, same):
    same(QUERIES[name](spark, small), duck.execute(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(name, spark, small):
    assert QUERIES[name](spark, small).columns


def test_entry_without_training_data_queries(spark):
    import __spark_entry__ as e

    assert set(plans.collect()[0]) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["url", "matched", "exact", "near", "score"]
