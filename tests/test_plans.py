"""Plan-shape checks over every registered query."""

import pytest

import __spark_entry__ as entry
from gitquarry.plans.registry import QUERIES

SMALL = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")
ML = {"matcher_simple_gbt", "matcher_broad_gbt", "matcher_rules_tree", "matcher_balanced_tree",
      "matcher_rules_errors", "matcher_rules_accuracy", "defect_prediction", "size_regression_summary",
      "size_regression_coefficients", "defect_score_equations"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ML))
def test_no_cross_or_nested_loop_join(spark, name):
    df = QUERIES[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for op in FORBIDDEN:
        assert op not in plan, (name, op)


def test_every_query_has_a_callable_and_oracles_are_a_subset():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(sql) >= 42
