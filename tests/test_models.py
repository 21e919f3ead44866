"""Compiled trees, index maps, regression summaries and samples against the
learners' own results."""

import random

import pytest
from pyspark.ml.feature import StringIndexer, VectorAssembler, VectorIndexer
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from gitquarry.operators import identity, indexing, models, regression, sampling, trees
from gitquarry.operators.trees import Leaf, Split
from gitquarry.plans import registry
from gitquarry.sources import adapters


def labelled(spark, n=600, seed=3):
    """Features of three kinds: continuous, few values (zero among them) and boolean."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = r.random(), r.choice([-1.5, 0.0, 0.25, 2.0]), float(r.random() < 0.3)
        score = a + (b in (0.0, 2.0)) * 0.5 + c * 0.4 + r.gauss(0, 0.15)
        rows.append((*[f"{x}{i}" for x in "pflqgm"], "T" if score > 1 else "U" if score > 0.8 else "F", a, b, c))
    return spark.createDataFrame(rows, [*identity.PAIR_COLS, "Label", "f1", "PF-Jaccard", "c1"])


@pytest.mark.parametrize("classifier, labels", [("tree", "TFU"), ("gbt", "TF")])
def test_compiled_matcher_equals_the_learner(spark, classifier, labels):
    df = labelled(spark).where(F.col("Label").isin(*labels))
    features = ["f1", "PF-Jaccard", "c1"]
    out = models.train_matcher(df, features, classifier, max_iter=8)
    both = out.transformed(df).select(*identity.PAIR_COLS, F.col("prediction").alias("learner"), F.col("predictedLabel").alias("label"))
    mine = df.withColumn("mine", out.predicted_index).withColumn("my_label", trees.label_of(F.col("mine"), out.labels))
    rows = mine.join(both, identity.PAIR_COLS).collect()
    assert len(rows) == df.count() > 300
    assert all(r.mine == r.learner and r.my_label == r.label for r in rows)
    assert len({r.mine for r in rows}) == len(labels)
    assert 0 < out.misclassified.count() < out.predictions.count()
    assert sum(r.n for r in out.confusion.collect()) == out.predictions.count()


def test_fit_is_bounded(spark):
    df = labelled(spark)
    few = models.train_matcher(df, ["f1"], "tree", max_labelled=20)
    assert few.predictions.count() == models.train_matcher(df, ["f1"], "tree").predictions.count()


@pytest.mark.parametrize("kind", ["broad", "simple"])
def test_fit_takes_the_whole_training_part(spark, kind):
    """Where f1 is 1, 25,000 rows are T and 22,000 F; 35,000 more T are elsewhere, so that 20,000 of each label have mostly F there."""
    features = identity.FEATURE_ORDER[kind]
    i = F.col("id").cast("string")
    df = spark.range(82_000).select(
        *[F.concat(F.lit(x), i).alias(c) for x, c in zip("pflqgm", identity.PAIR_COLS)], F.when(F.col("id") < 60_000, "T").otherwise("F").alias("Label"),
        *[((F.col("id") < 25_000) | (F.col("id") >= 60_000) if c == "f1" else F.lit(0)).cast("double").alias(c) for c in features])
    out = models.train_matcher(df, features, "gbt", max_iter=1)
    got = {(r.predictedLabel, r.Label): r.n for r in out.confusion.collect()}
    assert got["T", "T"] > 19_000 and got["T", "F"] > 6_500
    assert got["F", "F"] == got["F", "T"] == 0


def test_fit_does_not_depend_on_the_layout(spark, monkeypatch):
    df = labelled(spark, 24_000)
    monkeypatch.setattr(models, "ROWS_A_TASK", 5_000)
    fits = {models.train_matcher(df.repartition(n, c), ["f1", "PF-Jaccard", "c1"], "tree").predicted_index._jc.toString()
            for n, c in ((1, "Prefix"), (3, "Lastname"), (8, "f1"))}
    assert len(fits) == 1


def test_tree_expression_and_sql_agree(spark):
    tree = Split("x", Split("y", Leaf(0.0), Leaf(2.0), values=(1.0, 3.0)), Leaf(1.0), threshold=0.5)
    df = spark.createDataFrame([(None, 1.0), (0.5, 3.0), (0.5, None), (0.6, 1.0), (float("nan"), 1.0), (-1.0, 2.0)], "x double, y double")
    got = [r.v for r in df.select(trees.compile_tree(tree).alias("v")).collect()]
    assert got == [1.0, 0.0, 2.0, 1.0, 1.0, 2.0]
    assert [r.v for r in df.selectExpr(trees.to_sql(tree).replace('"', "`") + " AS v").collect()] == got
    vote = trees.compile_boosted([tree, Leaf(-1.0)], [1.0, 1.0])
    assert [r.v for r in df.select(vote.alias("v")).collect()] == [0.0, 0.0, 1.0, 0.0, 0.0, 1.0]


def test_index_maps_equal_the_fitted_indexers(spark):
    df = labelled(spark).withColumn("many", F.xxhash64("Prefix") % 11 / 3).repartition(5)
    df = df.unionByName(df.limit(0)).withColumn("nulls", F.lit(None).cast("double"))
    features = ["f1", "PF-Jaccard", "c1", "many"]
    fitted = StringIndexer(inputCol="Label", outputCol="i").fit(df)
    assert [r.label for r in indexing.label_index(df).orderBy("index").collect()] == list(fitted.labels)
    data = VectorAssembler(inputCols=features, outputCol="v").transform(df)
    for most in (4, 10, 30):
        vectors = VectorIndexer(inputCol="v", outputCol="w", maxCategories=most).fit(data)
        want = {(features[f], v, i) for f, m in vectors.categoryMaps.items() for v, i in m.items()}
        assert {(r.feature, r.value, r["index"]) for r in indexing.feature_index(df, features, most).collect()} == want
    assert indexing.feature_index(df, ["nulls"]).count() == 0


def test_equally_frequent_labels_go_by_name(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "Label string")
    assert [(r.label, r.n, r["index"]) for r in indexing.label_index(df).orderBy("index").collect()] == [("c", 2, 0), ("a", 1, 1), ("b", 1, 2)]


@pytest.mark.parametrize("predictors", [["x"], ["x", "y"], ["x", "y", "z"]])
def test_regression_equals_the_learners_summary(spark, predictors):
    r = random.Random(7)
    rows = [(x := r.gauss(1e4, 3), y := r.gauss(0, 1), z := r.random(), 5 + 2 * x - y + r.gauss(0, 4)) for _ in range(200)]
    df = spark.createDataFrame(rows, ["x", "y", "z", "v"]).repartition(4)
    model = GeneralizedLinearRegression(family="gaussian", labelCol="v", featuresCol="f").fit(
        VectorAssembler(inputCols=predictors, outputCol="f").transform(df))
    s = model.summary
    got = {x.term: x for x in regression.gaussian_fit(df.unionByName(spark.createDataFrame([(None, 1.0, 1.0, 1.0)], df.schema)), "v", predictors).collect()}
    order = [*predictors, "(Intercept)"]  # the learner lists the intercept last
    for i, term in enumerate(order):
        want = model.intercept if term == "(Intercept)" else float(model.coefficients[i])
        assert got[term].estimate == pytest.approx(want, rel=1e-6)
        assert got[term].std_error == pytest.approx(s.coefficientStandardErrors[i], rel=1e-5)
        assert got[term].t_value == pytest.approx(s.tValues[i], rel=1e-5)
        assert got[term].p_value == pytest.approx(s.pValues[i], rel=1e-4, abs=1e-12)
    one = got["(Intercept)"]
    assert (one.n, one.df_residual) == (200, s.residualDegreeOfFreedom)
    assert one.deviance == pytest.approx(s.deviance, rel=1e-8) and one.null_deviance == pytest.approx(s.nullDeviance, rel=1e-8)
    assert one.dispersion == pytest.approx(s.dispersion, rel=1e-8) and one.aic == pytest.approx(s.aic, rel=1e-9)


def test_regression_of_too_few_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], ["x", "v"])
    assert regression.gaussian_fit(df, "v", ["x"]).count() == 0
    assert regression.gaussian_fit(df.limit(0), "v", ["x"]).count() == 0


def test_bottom_k_sample_reads_its_input_once(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, r.choice(["T", "T", "T", "F", None])) for i in range(3000)] + [(3000, "U")]
    spark.createDataFrame(rows, "id long, Label string").repartition(6).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    sample = sampling.balanced_sample(df, "Label", 40, 5)
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Window" not in plan
    got = {}
    for x in sample.collect():
        got.setdefault(x.Label, set()).add(x.id)
    unit = {x.id: x.u for x in df.select("id", sampling.hash_unit(["id", "Label"], 5, df).alias("u")).collect()}
    want = {}
    for i, label in sorted(rows, key=lambda x: (unit[x[0]], x[0])):
        if len(want.setdefault(label, set())) < 40:
            want[label].add(i)
    assert got == want


def test_rest_of_a_hash_sample_is_the_set_difference(spark):
    df = spark.createDataFrame([(i % 50, i % 3) for i in range(400)], "a int, b int")
    train = sampling.bernoulli_sample(df, 0.4, 3)
    rest = sampling.rest_distinct(df, 0.4, 3)
    assert sorted(map(tuple, rest.collect())) == sorted(map(tuple, sampling.except_distinct(df, train).collect()))
    assert 0 < rest.count() < 150


def test_person_labels(spark):
    records = spark.createDataFrame([("a", "x", "y", 1), ("b", "x", "y", 1), ("c", "x", "z", 2), ("a", "x", "y", 1), (None, "x", "y", 1)],
                                    "Prefix string, Firstname string, Lastname string, person int")
    pairs = identity.candidate_pairs(records, "one_or_two")
    got = {(r.Prefix, r.Prefix_1): r.Label for r in identity.person_label(pairs, records, "person", uncertain=0, wrong=0).collect()}
    assert got == {("a", "b"): "T", ("b", "a"): "T", ("a", "c"): "F", ("c", "a"): "F", ("b", "c"): "F", ("c", "b"): "F"}
    assert {r.Label for r in identity.person_label(pairs, records, "person", uncertain=1).collect()} == {"U"}
    assert identity.person_label(pairs, records, "person", uncertain=0, wrong=1).where("Label = 'T'").count() == 4


def test_records_are_derived_once(spark, tmp_path):
    """The labelled pairs read the people from a table, not three times from the customers."""
    customers = spark.createDataFrame([(k, f"c{k}") for k in [*range(200), *range(90, 100)]] + [(None, "x"), (3, None)], "c_custkey long, c_name string")
    customers.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    labelled_pairs = registry._person_labelled(spark, str(tmp_path))
    plan = labelled_pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "c_custkey" not in plan
    records = identity.normalize_people(adapters.people(customers), keep=[F.expr("_id div 4").alias("person")])
    want = identity.person_label(identity.candidate_pairs(records, "one_or_two", 1000), records, "person", registry.LABEL_SEED)
    assert sorted(map(tuple, labelled_pairs.collect())) == sorted(map(tuple, want.collect())) != []
