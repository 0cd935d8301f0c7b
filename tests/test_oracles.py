"""Every query of the engine with SQL beside it, on the smallest tables."""

import pytest

from lodestar import queries, score_queries, store_queries  # noqa: F401
from tests.compare import oracle, rows


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, sf, name):
    assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(oracle(queries.ORACLES[name], sf))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
