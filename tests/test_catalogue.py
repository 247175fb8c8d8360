"""Every catalogued query against its SQL twin."""

import pytest
from compare import compare, duck

from emberfold.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, con, name):
    compare(catalogue.QUERIES[name](spark, FOLDER), con, catalogue.ORACLE_SQL[name])


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


def test_filters_and_columns_reach_the_scan(spark):
    df = catalogue.QUERIES["index_range_scan"](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_custkey), GreaterThan(o_custkey,10), LessThanOrEqual(o_custkey,20)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


@pytest.mark.parametrize("name", ["pricing_summary", "join_inner", "sub_not_in", "having", "distinct_on_ascending", "kv_latest", "asof_snapshot"])
def test_plans_have_no_python_and_no_cartesian_product(spark, name):
    plan = catalogue.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
