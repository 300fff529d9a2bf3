"""Every query against its SQL, and those without SQL for rows and a stable schema."""

import pytest
from conftest import plain

from pricescope.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(name, spark, sf_dir, duck):
    assert plain(registry.QUERIES[name](spark, sf_dir).toPandas()) == plain(duck.sql(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).columns


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[0] == "product_id"
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
