"""Every query of the core beside its SQL on the smallest tables."""

import pytest
from oracle import SMALL, differs, views

import __spark_entry__ as entry
from stelae.plans.registry import ORACLE, QUERIES


@pytest.fixture(scope="module")
def db():
    return views(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, db, name):
    assert differs(spark, db, SMALL, QUERIES[name], ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SMALL).columns


def test_every_sql_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["claim", "documents"] and found.count() > 0
