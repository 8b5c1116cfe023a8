"""Every registered query of the library against its SQL counterpart."""

from __future__ import annotations

import pytest

from caselight import plans

from .both_engines import comparable, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_matches_sql(spark, con, sf_dir, name):
    got = comparable(plans.QUERIES[name](spark, sf_dir).toPandas())
    assert got == comparable(con.sql(plans.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_other_queries_run(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0


def test_filters_reach_the_scan(spark, sf_dir):
    plan = plans.QUERIES["day_summary"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-05T00:00)" in plan and "LessThan(ts,2024-01-20T00:00)" in plan


def test_columns_are_pruned(spark, sf_dir):
    plan = plans.QUERIES["decision_counts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_type:string>" in plan
