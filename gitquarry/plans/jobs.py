"""The reference's jobs, each as one call over a table catalog.

Every function reads its named tables through ``catalog.load(name)`` (any
format; see ``gitquarry.sources.catalog.Catalog``) and returns DataFrames
instead of printing.  They are thin compositions of the operators.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gitquarry.functions.text import MONTH_FORMAT
from gitquarry.operators import activity, identity, inducing, labels, models, sampling
from gitquarry.sources.catalog import read_pairs_csv


def label_bugfixing_commits(catalog, project_like: str | None = None) -> DataFrame:
    """Commits with the bug-fix flag, optionally only those of projects
    whose name matches ``project_like``."""
    if project_like is None:
        return labels.label_bugfix(catalog.load("commit"))
    return labels.label_bugfix(catalog.load("commit"), projects=catalog.load("project"),
                               vcs_systems=catalog.load("vcs_system"), project_like=project_like)


def label_buginducing_commits(catalog, match: str = "first_hunk") -> DataFrame:
    """Distinct ids of the commits that induced later fixed bugs."""
    return inducing.bug_inducing(catalog.load("commit"), catalog.load("file_action"),
                                 catalog.load("hunk"), match=match)


def developer_activities(catalog, fmt: str = MONTH_FORMAT, bugfix_only: bool = False) -> DataFrame:
    """Messages, comments, commits and bug fixes per developer and period."""
    return activity.developer_activity(catalog.load("message"), catalog.load("issue_comment"),
                                       catalog.load("commit"), fmt=fmt, bugfix_only=bugfix_only)


def defect_prediction_example(catalog, registry: dict | None = None) -> DataFrame:
    """Logistic regression of the bug-fix flag on class metrics."""
    return models.defect_prediction(catalog.load("code_entity_state"), catalog.load("commit"), registry=registry)


def size_prediction_example(catalog, fraction: float = 0.5, seed: int = 42, registry: dict | None = None):
    """GLM of LOC on WMC and CBO: (coefficients, prediction summary)."""
    coef, preds = models.size_regression(catalog.load("code_entity_state"), fraction=fraction,
                                         seed=seed, registry=registry)
    return coef, models.prediction_summary(preds)


# Fixed values.  algorithm -> (pair mode, export share, feature kind, classifier, labels, split seed)
IDENTITY_ALGORITHMS = {
    "simple": ("two_of_three", 0.5, "simple", "gbt", ("T", "F"), None),
    "broad": ("one_or_two", 0.1, "broad", "gbt", ("T", "F"), None),
    "optimized": ("one_or_two", 0.1, "rules", "tree", ("T", "F", "U"), 90891),
    "balanced": ("one_or_two", 0.1, "rules", "tree", ("T", "F", "U"), None),
}


PER_LABEL = 100


@dataclass
class IdentityResult:
    candidates: DataFrame
    labelled: DataFrame
    matcher: models.MatcherResult


def identity_merging(catalog, algorithm: str = "optimized", labelled_path: str | None = None,
                     export_path: str | None = None, seed: int = 4242,
                     per_label: int = PER_LABEL) -> IdentityResult:
    """Candidate pairs of ``people``, optional export of a labelling sample
    (kept when the file exists), then features and the classifier of the
    chosen algorithm on labelled pairs.

    ``labelled_path`` names the manually labelled CSV; without it the rule
    label (``models.rule_label``) stands in for the manual step.  The
    balanced algorithm draws ``per_label`` pairs per label."""
    mode, share, kind, classifier, label_set, fixed_seed = IDENTITY_ALGORITHMS[algorithm]
    persons = identity.normalize_people(catalog.load("people"))
    candidates = identity.candidate_pairs(persons, mode)
    if export_path is not None:
        identity.label_sample(candidates, export_path, fraction=share, seed=500, mode="ignore")
    if labelled_path is not None:
        labelled = read_pairs_csv(catalog.spark, labelled_path)
    else:
        labelled = models.rule_label(identity.pair_features(candidates, "rules"))
    labelled = labelled.where(F.col("Label").isin(*label_set))
    if algorithm == "balanced":
        labelled = sampling.balanced_sample(labelled, "Label", per_label, seed,
                                            cols=identity.PAIR_COLS + ["Label"])
    feats = identity.pair_features(labelled, kind).na.fill(0.0)
    result = models.train_matcher(feats, identity.FEATURE_ORDER[kind], classifier,
                                  seed=fixed_seed if fixed_seed is not None else seed)
    return IdentityResult(candidates, labelled, result)
