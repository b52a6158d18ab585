"""Every registered query with SQL gives the rows of that SQL; the rest run and keep their invariants."""

import pytest
from conftest import SF
from oracle_check import compare

from callstrata.plans import catalog

# Searches of the full size take minutes; test_grouped_models and test_models cover them on planted series.
SLOW = {"compare_models", "grid_search", "validation_curve", "forecast_ensemble_trees"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(name, spark, con):
    assert compare(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - SLOW))
def test_runs(name, spark):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_every_sql_has_its_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() == 2
    assert e.queries().keys() >= catalog.QUERIES.keys()
