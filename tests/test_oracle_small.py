"""Registered queries against their DuckDB oracle SQL on the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.oracle_harness import compare, duck

SMALL = "/root/testdata/sf0.001"
SAMPLE = ["bugfix_labels_project", "developer_activity", "bug_inducing_pairs",
          "bug_inducing_pairs_per_hunk", "candidate_pairs_broad", "pair_features_broad",
          "balanced_sample", "size_regression_coefficients", "fixed_tree_scores", "matcher_feature_index",
          "dump_file_actions", "size_regression_fit", "defect_score_equations"]


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, con, name):
    info = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SMALL)
    assert info["ok"], info
