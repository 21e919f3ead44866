"""Learning jobs on Spark ML.

Estimators are distributed (tree statistics and gradients are aggregated
across executors); only fitted parameters reach the driver.  The matcher stores
its features, which three fits and the scoring read, as a table in the shared
checkpoint folder, so nothing stays cached and a lost executor costs a read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier,
                                       LogisticRegression)
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler, VectorIndexer
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gitquarry.functions.text import BUGFIX_PATTERN, is_bugfix
from gitquarry.operators.identity import PAIR_COLS
from gitquarry.operators import trees
from gitquarry.operators.sampling import balanced_sample, bernoulli_sample, except_distinct, hash_unit, random_split, rest_distinct
from gitquarry.session import materialize
from gitquarry.sources.catalog import load_logical


# ------------------------------------------------------------------ M1
def struct_to_features(df: DataFrame, struct_col: str, out_col: str = "features") -> DataFrame:
    """All numeric members of a struct become one vector column; the
    struct is dropped."""
    members = [f.name for f in df.schema[struct_col].dataType.fields]
    flat = df.select("*", *[F.col(f"{struct_col}.{m}").alias(f"_{struct_col}_{m}") for m in members])
    asm = VectorAssembler(inputCols=[f"_{struct_col}_{m}" for m in members], outputCol=out_col,
                          handleInvalid="error")
    return asm.transform(flat).drop(struct_col, *[f"_{struct_col}_{m}" for m in members])


# ------------------------------------------------------------------ A6 / M9 / P14
def confusion_matrix(predictions: DataFrame, labels: Sequence[str], predicted_col: str = "predictedLabel",
                     label_col: str = "Label") -> DataFrame:
    """One row per (predicted, label) cell of the label grid, zero-filled;
    a single grouped count instead of one filtered count per cell."""
    spark = predictions.sparkSession
    grid = spark.createDataFrame([(p, l) for p in labels for l in labels],
                                 f"{predicted_col} string, {label_col} string")
    counts = predictions.groupBy(predicted_col, label_col).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, [predicted_col, label_col], "left") \
        .select(predicted_col, label_col, F.coalesce("n", F.lit(0)).alias("n"))


def misclassified(predictions: DataFrame, predicted_col: str = "predictedLabel",
                  label_col: str = "Label") -> DataFrame:
    """Rows whose prediction differs from the label."""
    return predictions.where(F.col(predicted_col) != F.col(label_col)) \
        .select(*PAIR_COLS, predicted_col, label_col)


def accuracy(predictions: DataFrame, predicted_col: str = "predictedLabel",
             label_col: str = "Label") -> DataFrame:
    """M9: accuracy and test error in one pass."""
    hit = (F.col(predicted_col) == F.col(label_col)).cast("double")
    return predictions.agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n")) \
        .withColumn("test_error", F.lit(1.0) - F.col("accuracy"))


# ------------------------------------------------------------------ C10
#: Labelled rows for each task of a matcher's fit, about.
ROWS_A_TASK = 50_000


def _dealt_by_hash(train: DataFrame, label_col: str, feature_cols: Sequence[str], seed: int, tasks: int) -> DataFrame:
    """Label and features of all training rows, dealt out and ordered by
    what is in them: the learner draws its candidate thresholds by a row's place, so
    they don't hang on how the rows came in."""
    seen = [F.col(f"`{c}`") for c in (label_col, *feature_cols)]
    return train.select(*seen, hash_unit(PAIR_COLS, seed, train).alias("_u")) \
        .repartition(max(1, tasks), "_u").sortWithinPartitions(seen[0], "_u", *seen[1:]).drop("_u")


@dataclass
class MatcherResult:
    predictions: DataFrame
    confusion: DataFrame
    misclassified: DataFrame
    accuracy: DataFrame
    labels: list
    predicted_index: Column
    transformed: Callable[[DataFrame], DataFrame]


def train_matcher(features: DataFrame, feature_cols: Sequence[str], classifier: str = "gbt",
                  seed: int = 90891, train_fraction: float = 0.67, label_col: str = "Label",
                  split: str = "hash", max_iter: int = 20, max_labelled: int | None = None) -> MatcherResult:
    """M2-M9: assemble, index labels and features on all rows (as the
    reference does), split, fit on the whole training part, score the rest.

    Only a caller who gives ``max_labelled`` has the fit bounded, to that many rows of
    each label, those of smallest hash; scoring covers the whole test part.  The
    fitted trees are compiled to a column over the features
    (``predicted_index``; see ``operators.trees``), which scores the test part; ``transformed`` scores rows by the
    learner's own classes, for comparison."""
    if classifier not in ("gbt", "tree"):
        raise ValueError("classifier must be gbt or tree")
    asm = VectorAssembler(inputCols=list(feature_cols), outputCol="features", handleInvalid="error")
    rows = materialize(features.select(
        *PAIR_COLS, label_col, *[F.col(f"`{c}`").cast("double").alias(c) for c in feature_cols]), "table")
    data = asm.transform(rows)
    label_idx = StringIndexer(inputCol=label_col, outputCol="indexedLabel").fit(data)
    feat_idx = VectorIndexer(inputCol="features", outputCol="indexedFeatures", maxCategories=10).fit(data)
    train, test = random_split(rows, [train_fraction, 1 - train_fraction], seed, method=split, cols=PAIR_COLS)
    if max_labelled is None:
        train = _dealt_by_hash(train, label_col, feature_cols, seed, -(-rows.count() // ROWS_A_TASK))
    else:
        train = balanced_sample(train, label_col, max_labelled, seed, cols=PAIR_COLS)
    train = asm.transform(train)
    learner = GBTClassifier(labelCol="indexedLabel", featuresCol="indexedFeatures", maxIter=max_iter, seed=seed) if classifier == "gbt" \
        else DecisionTreeClassifier(labelCol="indexedLabel", featuresCol="indexedFeatures", seed=seed)
    labels = list(label_idx.labels)
    conv = IndexToString(inputCol="prediction", outputCol="predictedLabel", labels=labels)
    model = Pipeline(stages=[label_idx, feat_idx, learner, conv]).fit(train)
    fitted, names = model.stages[2], list(feature_cols)
    index = trees.compile_boosted(*trees.read_boosted(fitted, names, feat_idx)) if classifier == "gbt" \
        else trees.compile_tree(trees.read_tree(fitted, names, feat_idx))
    preds = test.withColumn("prediction", index).withColumn("predictedLabel", trees.label_of(F.col("prediction"), labels))
    return MatcherResult(preds, confusion_matrix(preds, labels, label_col=label_col),
                         misclassified(preds, label_col=label_col),
                         accuracy(preds, label_col=label_col), labels, index, lambda df: model.transform(asm.transform(df)))


# ------------------------------------------------------------------ labelled pairs
def rule_label(features_rules: DataFrame, keep_features: bool = False) -> DataFrame:
    """Label pairs by rule, standing in for the manual labelling step:
    T when a name-order rule holds or both name similarities reach 0.9,
    F when no same-field similarity reaches 0.7, U otherwise.
    ``keep_features`` keeps the rule features next to the label."""
    rule = F.col("c1")
    for i in range(2, 8):
        rule = rule | F.col(f"c{i}")
    strong = (F.col("f5") >= 0.9) & (F.col("f9") >= 0.9)
    weak = F.greatest("f1", "f5", "f9") < 0.7
    label = F.when(rule | strong, "T").when(weak, "F").otherwise("U")
    if keep_features:
        return features_rules.withColumn("Label", label)
    return features_rules.select(*PAIR_COLS, label.alias("Label"))


# ------------------------------------------------------------------ C3
def defect_prediction(entity_states: DataFrame, commits: DataFrame,
                      pattern: str = BUGFIX_PATTERN, ce_type_like: str = "class",
                      registry: dict | None = None, tol: float = 1e-6) -> DataFrame:
    """Logistic regression of the bug-fix flag on class metrics, trained
    and scored on the same rows (as the reference does).  Entities of
    commits whose message is null (flag null) cannot be labelled and are
    left out.  ``regression.score_equations`` checks the fit; ``tol`` ends it."""
    states = load_logical(entity_states, "code_entity_state",
                          [["RID"], ["AbstractionLevel"], ["ProductMetric", "JavaClass"]], registry) \
        .select("commit_id", "metrics", "ce_type")
    labelled = commits.select(F.col("_id").alias("commit_id"),
                              is_bugfix("message", pattern).alias("bugfix"))
    df = states.join(labelled, "commit_id").drop("commit_id") \
        .where(F.col("ce_type").like(ce_type_like)).drop("ce_type") \
        .where(F.col("bugfix").isNotNull()) \
        .withColumn("bugfix_double", F.col("bugfix").cast("double"))
    # the estimator persists its own uncached input for the duration of the fit
    df = struct_to_features(df, "metrics", "features")
    model = LogisticRegression(labelCol="bugfix_double", featuresCol="features", tol=tol).fit(df)
    return model.transform(df)


# ------------------------------------------------------------------ C11 / M11 / M12
def size_rows(entity_states: DataFrame, response: str = "LOC", predictors: Sequence[str] = ("WMC", "CBO"),
              ce_type: str = "class", registry: dict | None = None) -> DataFrame:
    """The class metrics that the size regression is fitted and applied on."""
    states = load_logical(entity_states, "code_entity_state",
                          [["AbstractionLevel"], ["ProductMetric", "JavaClass"]], registry)
    return states.where(F.col("ce_type") == ce_type).select(*[F.col(f"metrics.{c}").alias(c) for c in [response, *predictors]])


def size_regression(entity_states: DataFrame, response: str = "LOC",
                    predictors: Sequence[str] = ("WMC", "CBO"), fraction: float = 0.5,
                    seed: int = 42, ce_type: str = "class", sample: str = "hash",
                    registry: dict | None = None):
    """Gaussian GLM ``response ~ predictors`` fitted on a sample of the
    class metrics and applied to the rest (EXCEPT DISTINCT of the sample).

    Returns (coefficients DataFrame, predictions DataFrame)."""
    selected = size_rows(entity_states, response, predictors, ce_type, registry)
    # a hash filter over one scan: cheaper to recompute for EXCEPT than to cache;
    # the Gaussian fit is a single aggregation pass
    train = bernoulli_sample(selected, fraction, seed, method=sample)
    test = rest_distinct(selected, fraction, seed) if sample == "hash" else except_distinct(selected, train)
    asm = VectorAssembler(inputCols=list(predictors), outputCol="features")
    glm = GeneralizedLinearRegression(family="gaussian", link="identity", labelCol=response,
                                      featuresCol="features")
    model = glm.fit(asm.transform(train))
    spark = entity_states.sparkSession
    terms = ["(Intercept)", *predictors]
    values = [float(model.intercept), *[float(v) for v in model.coefficients]]
    coef = spark.createDataFrame(list(zip(terms, values)), "term string, estimate double")
    preds = model.transform(asm.transform(test))
    return coef, preds


def prediction_summary(predictions: DataFrame, col: str = "prediction") -> DataFrame:
    """Count, mean, stddev, min, quartiles and max of the predictions."""
    return predictions.select(col).summary()
