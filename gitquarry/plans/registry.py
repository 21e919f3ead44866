"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame
computed over the whole derived tables of that folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gitquarry.functions import text
from gitquarry.operators import activity, identity, indexing, inducing, labels, models, regression, sampling, trees
from gitquarry.operators.trees import Leaf, Split
from gitquarry.plans import oracle
from gitquarry.session import materialize, scratch_path
from gitquarry.sources import adapters
from gitquarry.sources.adapters import RepoTables
from gitquarry.sources.catalog import (load_logical, parse_documents, preview, read_pairs_csv, registry_table, sql_with, with_parent_keys,
                                       write_csv)

PROJECT_LIKE = "A%"
DAY_FORMAT = "yyyy-MM-dd"


def q_bugfix_labels(spark: SparkSession, root: str) -> DataFrame:
    t = RepoTables(spark, root)
    return labels.label_bugfix(t.commits())


def q_bugfix_labels_project(spark: SparkSession, root: str) -> DataFrame:
    t = RepoTables(spark, root)
    return labels.label_bugfix(t.commits(), projects=t.projects(), vcs_systems=t.vcs_systems(),
                               project_like=PROJECT_LIKE)


def q_bugfix_daily_counts(spark: SparkSession, root: str) -> DataFrame:
    t = RepoTables(spark, root)
    return activity.bugfix_counts(t.commits(), DAY_FORMAT)


def q_developer_activity(spark: SparkSession, root: str) -> DataFrame:
    t = RepoTables(spark, root)
    return activity.developer_activity(t.messages(), t.issue_comments(), t.commits(), DAY_FORMAT)


def q_developer_activity_fixes_only(spark: SparkSession, root: str) -> DataFrame:
    t = RepoTables(spark, root)
    return activity.developer_activity(t.messages(), t.issue_comments(), t.commits(), DAY_FORMAT,
                                       bugfix_only=True)


def q_developer_activity_monthly(spark: SparkSession, root: str) -> DataFrame:
    t = RepoTables(spark, root)
    return activity.developer_activity(
        adapters.volume_messages(t.t("orders")), adapters.volume_comments(t.t("lineitem")),
        adapters.volume_commits(t.t("lineitem")), "yyyy-MM")


def _inducing_inputs(spark, root):
    t = RepoTables(spark, root)
    return t.commits(), t.file_actions(), t.hunks()


def q_bug_inducing(spark: SparkSession, root: str) -> DataFrame:
    return inducing.bug_inducing(*_inducing_inputs(spark, root), match="first_hunk")


def q_bug_inducing_per_hunk(spark: SparkSession, root: str) -> DataFrame:
    return inducing.bug_inducing(*_inducing_inputs(spark, root), match="per_hunk")


def q_bug_inducing_pairs(spark: SparkSession, root: str) -> DataFrame:
    return inducing.fix_to_inducing(*_inducing_inputs(spark, root), match="first_hunk")


def q_bug_inducing_pairs_per_hunk(spark: SparkSession, root: str) -> DataFrame:
    return inducing.fix_to_inducing(*_inducing_inputs(spark, root), match="per_hunk")


# Fixed values of the jobs: the seeds 500 (labelling sample) and 42 (size regression, below).
SAMPLE_SEED = 500
BALANCE_SEED = 7
PER_LABEL = 150
#: Small, so that the derived people's largest blocks (60 and 52 records) are dealt over a grid.
HOT_PAIRS = 1000


def _persons(spark, root):
    return identity.normalize_people(RepoTables(spark, root).people())


def q_people_normalized(spark: SparkSession, root: str) -> DataFrame:
    return _persons(spark, root)


def q_candidate_pairs(spark: SparkSession, root: str) -> DataFrame:
    return identity.candidate_pairs(_persons(spark, root), "two_of_three", HOT_PAIRS)


def q_candidate_pairs_broad(spark: SparkSession, root: str) -> DataFrame:
    return identity.candidate_pairs(_persons(spark, root), "one_or_two", HOT_PAIRS)


def _features(spark, root, kind):
    return identity.pair_features(q_candidate_pairs_broad(spark, root), kind)


def q_pair_features_simple(spark: SparkSession, root: str) -> DataFrame:
    return _features(spark, root, "simple")


def q_pair_features_broad(spark: SparkSession, root: str) -> DataFrame:
    return _features(spark, root, "broad")


def q_pair_features_rules(spark: SparkSession, root: str) -> DataFrame:
    return _features(spark, root, "rules")


def _labelled(spark, root):
    return models.rule_label(_features(spark, root, "rules"))


def q_labelled_pairs(spark: SparkSession, root: str) -> DataFrame:
    return _labelled(spark, root)


def q_labelling_sample(spark: SparkSession, root: str) -> DataFrame:
    pairs = q_candidate_pairs_broad(spark, root)
    return sampling.random_split(pairs, [0.1, 0.9], SAMPLE_SEED)[0]


def q_balanced_sample(spark: SparkSession, root: str) -> DataFrame:
    return sampling.balanced_sample(_labelled(spark, root), "Label", PER_LABEL, BALANCE_SEED)


def q_rule_confusion(spark: SparkSession, root: str) -> DataFrame:
    simple = identity.pair_features(_labelled(spark, root), "simple")
    pred = F.when((F.col("f2") >= 0.85) & (F.col("f3") >= 0.85), "T") \
        .when(F.greatest("f4", "f5", "f6") < 0.5, "F").otherwise("U")
    return models.confusion_matrix(simple.select("Label", pred.alias("predictedLabel")), ["T", "F", "U"])


#: Seed of the noise in the labels, and of the matchers' split (the latter a fixed value of the job).
LABEL_SEED, SPLIT_SEED, TRAIN_FRACTION = 11, 90891, 0.67


def _person_labelled(spark, root, kind=None):
    """Candidate pairs, with features of ``kind``, labelled by the person who
    wrote the records, which no matcher sees.  The records are read by the
    pairs and twice by the labels, so they are derived once, into a table, by
    as many tasks as there are cores however few splits the customers have.
    Nulls are dropped on reading it: as a filter on the derived names it would
    be pushed below the exchange and derive them there as well."""
    customers = RepoTables(spark, root).t("customer").select("c_custkey", "c_name").hint("rebalance")
    records = identity.normalize_people(adapters.people(customers), drop_null=False, keep=[F.expr("_id div 4").alias("person")])
    records = materialize(records, "table").dropna(subset=identity.NAME_COLS)
    pairs = identity.candidate_pairs(records, "one_or_two", HOT_PAIRS)
    feats = pairs if kind is None else identity.pair_features(pairs, kind)
    return identity.person_label(feats, records, "person", LABEL_SEED)


def q_person_labels(spark: SparkSession, root: str) -> DataFrame:
    return _person_labelled(spark, root)


def q_matcher_split_totals(spark: SparkSession, root: str) -> DataFrame:
    """Rows of each label in the training and the test part."""
    parts = sampling.random_split(_person_labelled(spark, root), [TRAIN_FRACTION, 1 - TRAIN_FRACTION], SPLIT_SEED,
                                  cols=identity.PAIR_COLS)
    both = parts[0].withColumn("part", F.lit("train")).unionByName(parts[1].withColumn("part", F.lit("test")))
    return both.groupBy("part", "Label").agg(F.count(F.lit(1)).alias("n"))


def q_matcher_label_index(spark: SparkSession, root: str) -> DataFrame:
    return indexing.label_index(_person_labelled(spark, root))


def q_matcher_feature_index(spark: SparkSession, root: str) -> DataFrame:
    return indexing.feature_index(_features(spark, root, "rules"), identity.FEATURE_ORDER["rules"])


#: A small tree and a small ensemble over the rule features: what a fit may give, but fixed, so that SQL can repeat it.
FIXED_LABELS = ["F", "T", "U"]
FIXED_TREE = Split("c7", Split("f5", Split("f9", Leaf(0.0), Leaf(2.0), threshold=0.72),
                               Split("f1", Leaf(2.0), Leaf(1.0), threshold=0.55), threshold=0.81),
                   Leaf(1.0), values=(0.0,))
FIXED_BOOSTED = ([Split("f1", Leaf(-1.0), Leaf(1.0), threshold=0.7), Split("f5", Leaf(-0.6), Split("f9", Leaf(-0.1), Leaf(0.9), threshold=0.9), threshold=0.8),
                  Split("c1", Leaf(-0.2), Leaf(0.8), values=(0.0,))], [1.0, 0.5, 0.5])


def _fixed_predictions(spark, root):
    feats = _person_labelled(spark, root, "rules")
    return feats.withColumn("predictedLabel", trees.label_of(trees.compile_tree(FIXED_TREE), FIXED_LABELS))


def q_fixed_tree_scores(spark: SparkSession, root: str) -> DataFrame:
    """M5-M7 as expressions: label of the tree, vote of the ensemble."""
    scored = _fixed_predictions(spark, root).withColumn("boosted", trees.compile_boosted(*FIXED_BOOSTED))
    return scored.select(*identity.PAIR_COLS, "Label", "predictedLabel", "boosted")


def q_fixed_tree_errors(spark: SparkSession, root: str) -> DataFrame:
    return models.misclassified(_fixed_predictions(spark, root))


def q_fixed_tree_accuracy(spark: SparkSession, root: str) -> DataFrame:
    out = models.accuracy(_fixed_predictions(spark, root))
    return out.select(F.round("accuracy", 9).alias("accuracy"), "n", F.round("test_error", 9).alias("test_error"))


def q_fixed_tree_confusion(spark: SparkSession, root: str) -> DataFrame:
    return models.confusion_matrix(_fixed_predictions(spark, root), FIXED_LABELS)


def q_fixed_tree_errors_sql(spark: SparkSession, root: str) -> DataFrame:
    """SQL text over the predictions."""
    return sql_with(spark, "SELECT Label, predictedLabel, count(*) AS n, min(Lastname) AS first_name FROM {preds} "
                    "WHERE Label <> predictedLabel GROUP BY Label, predictedLabel", preds=_fixed_predictions(spark, root))


def _matcher(spark, root, kind, classifier, labels, balanced=False):
    feats = _person_labelled(spark, root, kind).where(F.col("Label").isin(*labels))
    if balanced:
        feats = sampling.balanced_sample(feats, "Label", PER_LABEL, BALANCE_SEED, cols=identity.PAIR_COLS)
    return models.train_matcher(feats.na.fill(0.0), identity.FEATURE_ORDER[kind], classifier, seed=SPLIT_SEED,
                                train_fraction=TRAIN_FRACTION)


def q_matcher_simple_gbt(spark: SparkSession, root: str) -> DataFrame:
    return _matcher(spark, root, "simple", "gbt", ["T", "F"]).confusion


def q_matcher_broad_gbt(spark: SparkSession, root: str) -> DataFrame:
    return _matcher(spark, root, "broad", "gbt", ["T", "F"]).confusion


def q_matcher_rules_tree(spark: SparkSession, root: str) -> DataFrame:
    return _matcher(spark, root, "rules", "tree", ["T", "F", "U"]).confusion


def q_matcher_balanced_tree(spark: SparkSession, root: str) -> DataFrame:
    return _matcher(spark, root, "rules", "tree", ["T", "F", "U"], balanced=True).confusion


def q_matcher_rules_errors(spark: SparkSession, root: str) -> DataFrame:
    return _matcher(spark, root, "rules", "tree", ["T", "F", "U"]).misclassified


def q_matcher_rules_accuracy(spark: SparkSession, root: str) -> DataFrame:
    return _matcher(spark, root, "rules", "tree", ["T", "F", "U"]).accuracy


def q_people_joined_names(spark: SparkSession, root: str) -> DataFrame:
    """The three name columns joined, and whether the mailbox holds the last name."""
    return _persons(spark, root).select(
        text.concatenated("Prefix", "Firstname", "Lastname").alias("joined"), text.contains("Prefix", "Lastname").alias("holds_last"))


def q_labelled_csv(spark: SparkSession, root: str) -> DataFrame:
    """The labelled pairs written as CSV and read back."""
    path = scratch_path(spark)
    write_csv(_person_labelled(spark, root), path)
    return read_pairs_csv(spark, path)


def q_dump_commits(spark: SparkSession, root: str) -> DataFrame:
    """Commit documents of both generations from JSON lines."""
    docs, _ = parse_documents(adapters.commit_lines(RepoTables(spark, root).t("events")), "commit")
    return docs.select("_id", "committer_id", F.unix_millis("committer_date").alias("committed_ms"), "message", F.size("file_action_ids").alias("n_file_actions"))


def q_dump_dead_letters(spark: SparkSession, root: str) -> DataFrame:
    return parse_documents(adapters.commit_lines(RepoTables(spark, root).t("events")), "commit")[1]


def q_dump_file_actions(spark: SparkSession, root: str) -> DataFrame:
    """Children that hold their parent's id, or are listed by it."""
    events = RepoTables(spark, root).t("events")
    commits_, _ = parse_documents(adapters.commit_lines(events), "commit")
    actions, _ = parse_documents(adapters.file_action_lines(events), "file_action")
    return with_parent_keys(actions, commits_, "file_action_ids", "commit_id").select("_id", "commit_id", "file_id")


def q_entity_states_registry(spark: SparkSession, root: str) -> DataFrame:
    """S2 with the registry as a table."""
    states = load_logical(RepoTables(spark, root).code_entity_states(), "code_entity_state",
                          [["RID"], ["ProductMetric"]], registry_table(spark))
    return states.select("_id", "commit_id", "file_id", "metrics.LOC", "metrics.WMC", "metrics.CBO", "metrics.NOM")


def q_entity_states_logical(spark: SparkSession, root: str) -> DataFrame:
    states = load_logical(RepoTables(spark, root).code_entity_states(), "code_entity_state",
                          [["RID"], ["AbstractionLevel"], ["ProductMetric", "JavaClass"]])
    return states.select("_id", "commit_id", "file_id", "ce_type", "metrics.LOC", "metrics.WMC",
                         "metrics.CBO")


def q_defect_prediction(spark: SparkSession, root: str) -> DataFrame:
    t = RepoTables(spark, root)
    preds = models.defect_prediction(t.code_entity_states(), t.commits())
    return preds.select("bugfix", "bugfix_double", "prediction",
                        vector_to_array("probability")[1].alias("p_bugfix"))


GLM_FRACTION, GLM_SEED, GLM_DIGITS = 0.5, 42, 3


def q_size_regression_coefficients(spark: SparkSession, root: str) -> DataFrame:
    coef, _ = models.size_regression(RepoTables(spark, root).code_entity_states(),
                                     fraction=GLM_FRACTION, seed=GLM_SEED)
    return coef.select("term", F.round("estimate", GLM_DIGITS).alias("estimate"))


def q_size_regression_summary(spark: SparkSession, root: str) -> DataFrame:
    _, preds = models.size_regression(RepoTables(spark, root).code_entity_states(),
                                      fraction=GLM_FRACTION, seed=GLM_SEED)
    return models.prediction_summary(preds)


SIGNIFICANT = "%.5e"


def _six_digits(df: DataFrame, *columns: str) -> list:
    return [F.format_string(SIGNIFICANT, F.col(c)).alias(c) for c in columns]


def q_size_regression_fit(spark: SparkSession, root: str) -> DataFrame:
    """Six significant digits of everything but the p values."""
    rows = sampling.bernoulli_sample(models.size_rows(RepoTables(spark, root).code_entity_states()), GLM_FRACTION, GLM_SEED)
    fit = regression.gaussian_fit(rows, "LOC", ["WMC", "CBO"])
    return fit.select("term", "n", "df_residual", *_six_digits(fit, "estimate", "std_error", "t_value", "deviance", "null_deviance",
                                                               "dispersion", "aic"))


def q_size_regression_test_rows(spark: SparkSession, root: str) -> DataFrame:
    """The rows that the fit is applied to."""
    return sampling.rest_distinct(models.size_rows(RepoTables(spark, root).code_entity_states()), GLM_FRACTION, GLM_SEED)


def q_defect_score_equations(spark: SparkSession, root: str) -> DataFrame:
    """The fit's score equations; ``fitted`` equals what
    the labels alone give, to four significant digits."""
    t = RepoTables(spark, root)
    scored = models.defect_prediction(t.code_entity_states(), t.commits(), tol=1e-12)
    return regression.score_equations(scored, ["LOC", "WMC", "CBO"]).select(
        "term", F.format_string("%.3e", "observed").alias("observed"), F.format_string("%.3e", "fitted").alias("fitted"))


def q_bug_inducing_count(spark: SparkSession, root: str) -> DataFrame:
    return inducing.count_inducing(inducing.bug_inducing(*_inducing_inputs(spark, root)))


TOP_N = 100


def q_developer_activity_top(spark: SparkSession, root: str) -> DataFrame:
    df = q_developer_activity(spark, root)
    return preview(df, TOP_N, *df.columns)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "bugfix_labels": q_bugfix_labels,
    "bugfix_labels_project": q_bugfix_labels_project,
    "bugfix_daily_counts": q_bugfix_daily_counts,
    "developer_activity": q_developer_activity,
    "developer_activity_fixes_only": q_developer_activity_fixes_only,
    "developer_activity_monthly": q_developer_activity_monthly,
    "bug_inducing": q_bug_inducing,
    "bug_inducing_per_hunk": q_bug_inducing_per_hunk,
    "bug_inducing_pairs": q_bug_inducing_pairs,
    "bug_inducing_pairs_per_hunk": q_bug_inducing_pairs_per_hunk,
    "people_normalized": q_people_normalized,
    "candidate_pairs": q_candidate_pairs,
    "candidate_pairs_broad": q_candidate_pairs_broad,
    "pair_features_simple": q_pair_features_simple,
    "pair_features_broad": q_pair_features_broad,
    "pair_features_rules": q_pair_features_rules,
    "labelled_pairs": q_labelled_pairs,
    "labelling_sample": q_labelling_sample,
    "balanced_sample": q_balanced_sample,
    "rule_confusion": q_rule_confusion,
    "matcher_simple_gbt": q_matcher_simple_gbt,
    "matcher_broad_gbt": q_matcher_broad_gbt,
    "matcher_rules_tree": q_matcher_rules_tree,
    "matcher_balanced_tree": q_matcher_balanced_tree,
    "matcher_rules_errors": q_matcher_rules_errors,
    "matcher_rules_accuracy": q_matcher_rules_accuracy,
    "entity_states_logical": q_entity_states_logical,
    "defect_prediction": q_defect_prediction,
    "size_regression_coefficients": q_size_regression_coefficients,
    "size_regression_summary": q_size_regression_summary,
    "bug_inducing_count": q_bug_inducing_count,
    "developer_activity_top": q_developer_activity_top,
    "person_labels": q_person_labels,
    "matcher_split_totals": q_matcher_split_totals,
    "matcher_label_index": q_matcher_label_index,
    "matcher_feature_index": q_matcher_feature_index,
    "fixed_tree_scores": q_fixed_tree_scores,
    "fixed_tree_errors": q_fixed_tree_errors,
    "fixed_tree_accuracy": q_fixed_tree_accuracy,
    "fixed_tree_confusion": q_fixed_tree_confusion,
    "fixed_tree_errors_sql": q_fixed_tree_errors_sql,
    "people_joined_names": q_people_joined_names,
    "labelled_csv": q_labelled_csv,
    "dump_commits": q_dump_commits,
    "dump_dead_letters": q_dump_dead_letters,
    "dump_file_actions": q_dump_file_actions,
    "entity_states_registry": q_entity_states_registry,
    "size_regression_fit": q_size_regression_fit,
    "size_regression_test_rows": q_size_regression_test_rows,
    "defect_score_equations": q_defect_score_equations,
}

ORACLE: dict[str, str] = {
    "bugfix_labels": oracle.bugfix_labels(),
    "bugfix_labels_project": oracle.bugfix_labels_project(PROJECT_LIKE),
    "bugfix_daily_counts": oracle.bugfix_counts("%Y-%m-%d"),
    "developer_activity": oracle.developer_activity("%Y-%m-%d", False),
    "developer_activity_fixes_only": oracle.developer_activity("%Y-%m-%d", True),
    "developer_activity_monthly": oracle.developer_activity("%Y-%m", False, volume=True),
    "bug_inducing": oracle.bug_inducing("first_hunk"),
    "bug_inducing_per_hunk": oracle.bug_inducing("per_hunk"),
    "bug_inducing_pairs": oracle.bug_inducing_pairs("first_hunk"),
    "bug_inducing_pairs_per_hunk": oracle.bug_inducing_pairs("per_hunk"),
    "people_normalized": oracle.people_normalized(),
    "candidate_pairs": oracle.candidate_pairs("two_of_three"),
    "candidate_pairs_broad": oracle.candidate_pairs("one_or_two"),
    "pair_features_simple": oracle.pair_features("simple"),
    "pair_features_broad": oracle.pair_features("broad"),
    "pair_features_rules": oracle.pair_features("rules"),
    "labelled_pairs": oracle.labelled_pairs(),
    "labelling_sample": oracle.labelling_sample("one_or_two", 0.1, SAMPLE_SEED),
    "balanced_sample": oracle.balanced_sample(PER_LABEL, BALANCE_SEED),
    "rule_confusion": oracle.rule_confusion(),
    "entity_states_logical": oracle.entity_states_logical(),
    "size_regression_coefficients": oracle.size_regression_coefficients(GLM_FRACTION, GLM_SEED,
                                                                        GLM_DIGITS),
    "bug_inducing_count": oracle.bug_inducing_count("first_hunk"),
    "developer_activity_top": oracle.developer_activity_top("%Y-%m-%d", TOP_N),
    "person_labels": oracle.person_labels(LABEL_SEED),
    "matcher_split_totals": oracle.matcher_split_totals(LABEL_SEED, TRAIN_FRACTION, SPLIT_SEED),
    "matcher_label_index": oracle.matcher_label_index(LABEL_SEED),
    "matcher_feature_index": oracle.matcher_feature_index(identity.FEATURE_ORDER["rules"], indexing.MAX_CATEGORIES),
    "fixed_tree_scores": oracle.fixed_tree(LABEL_SEED, trees.to_sql(FIXED_TREE), FIXED_LABELS, [trees.to_sql(t) for t in FIXED_BOOSTED[0]],
                                           FIXED_BOOSTED[1]) + "SELECT * FROM pred",
    **{f"fixed_tree_{k}": oracle.fixed_tree(LABEL_SEED, trees.to_sql(FIXED_TREE), FIXED_LABELS) + v
       for k, v in oracle.FIXED_TREE_QUERIES.items()},
    "people_joined_names": oracle.people_joined_names(),
    "labelled_csv": oracle.labelled_csv(LABEL_SEED),
    "dump_commits": oracle.dump_commits(),
    "dump_dead_letters": oracle.dump_dead_letters(),
    "dump_file_actions": oracle.dump_file_actions(),
    "entity_states_registry": oracle.entity_states_registry(),
    "size_regression_fit": oracle.size_regression_fit(GLM_FRACTION, GLM_SEED),
    "size_regression_test_rows": oracle.size_regression_test_rows(GLM_FRACTION, GLM_SEED),
    "defect_score_equations": oracle.defect_score_equations(),
}
