import json

import pytest

from pyspark.sql import functions as F

from gitquarry.operators.sampling import balanced_sample, except_distinct, hash_split
from gitquarry.plans.jobs import developer_activities
from gitquarry.session import checkpoint_dir
from gitquarry.sources.catalog import (COMMIT_DUMP_SCHEMA, FILE_ACTION_DUMP_SCHEMA, Catalog, explode_child_keys, load_logical,
                                       parse_documents, read_document_dump, read_pairs_csv, registry_table, write_csv)
from gitquarry.sources import adapters


def test_document_dump_normalised(spark, tmp_path):
    doc = {"_id": {"$oid": "c1"}, "projectId": {"$oid": "p1"}, "revisionHash": "ab",
           "branches": ["main"], "tagIds": [], "parents": [], "authorId": {"$oid": "a1"},
           "committerId": {"$oid": "a2"}, "authorDate": {"$date": "2017-05-01T10:00:00.000+0000"},
           "committerDate": {"$date": "2017-05-01T11:30:00.000+0000"}, "authorOffset": 120,
           "committerOffset": 120, "message": "fix\nline", "fileActionIds": [{"$oid": "f1"}, {"$oid": "f2"}]}
    p = tmp_path / "commit.json"
    p.write_text(json.dumps(doc) + "\n")
    df = read_document_dump(spark, str(p), COMMIT_DUMP_SCHEMA)
    r = df.collect()[0]
    assert r._id == "c1" and r.committer_id == "a2" and r.file_action_ids == ["f1", "f2"]
    assert r.committer_date.hour == 11 and r.tag_ids == []
    kids = explode_child_keys(df, "file_action_ids", "commit_id").collect()
    assert sorted((k._id, k.commit_id) for k in kids) == [("f1", "c1"), ("f2", "c1")]
    fa = {"_id": {"$oid": "f1"}, "fileId": {"$oid": "x"}, "hunkIds": [{"$oid": "h1"}], "isBinary": False}
    q = tmp_path / "fa.json"
    q.write_text(json.dumps(fa) + "\n")
    assert read_document_dump(spark, str(q), FILE_ACTION_DUMP_SCHEMA).collect()[0].hunk_ids == ["h1"]


def test_pairs_csv_round_trip(spark, tmp_path):
    rows = [("a", "b", "c", "d", "e", "", "T")]
    df = spark.createDataFrame(rows, "Prefix string, Firstname string, Lastname string, "
                               "Prefix_1 string, Firstname_1 string, Lastname_1 string, Label string")
    out = str(tmp_path / "pairs")
    write_csv(df, out, single_file=True)
    write_csv(df, out, mode="ignore")  # existing file kept
    back = read_pairs_csv(spark, out).collect()
    assert back[0].Lastname_1 is None and back[0].Label == "T"


def test_logical_scan_keeps_requested_types(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    states = adapters.code_entity_states(li)
    out = load_logical(states, "code_entity_state", [["AbstractionLevel"], ["ProductMetric", "JavaClass"]])
    assert out.columns == ["ce_type", "metrics"]
    assert [f.name for f in out.schema["metrics"].dataType.fields] == ["LOC", "WMC", "CBO"]


def test_hash_split_is_a_partition_and_repeatable(spark):
    df = spark.range(2000).withColumn("x", F.col("id") * 2)
    a, b = hash_split(df, [0.3, 0.7], 500)
    a2, _ = hash_split(df.repartition(7), [0.3, 0.7], 500)
    ids_a = {r.id for r in a.collect()}
    assert ids_a == {r.id for r in a2.collect()}
    assert ids_a.isdisjoint({r.id for r in b.collect()}) and a.count() + b.count() == 2000
    assert 450 < len(ids_a) < 750
    assert except_distinct(df.union(df), a).count() == b.count()


def test_balanced_sample_caps_each_label(spark):
    df = spark.range(3000).withColumn("Label", F.when(F.col("id") < 2000, "T")
                                      .when(F.col("id") < 2100, "F").otherwise("U"))
    got = {r.Label: r.n for r in balanced_sample(df, "Label", 150, 3)
           .groupBy("Label").agg(F.count("*").alias("n")).collect()}
    assert got == {"T": 150, "F": 100, "U": 150}
    # exact: the same rows as ranking every row of a label by its hash
    from pyspark.sql import Window
    from gitquarry.operators.sampling import hash_unit
    w = Window.partitionBy("Label").orderBy(hash_unit(df.columns, 3, df), "id", "Label")
    brute = df.withColumn("rn", F.row_number().over(w)).where("rn <= 150")
    got_ids = sorted(r.id for r in balanced_sample(df, "Label", 150, 3).collect())
    assert got_ids == sorted(r.id for r in brute.collect())
    nulls = df.withColumn("Label", F.when(F.col("id") < 5, F.lit(None)).otherwise(F.col("Label")))
    assert balanced_sample(nulls, "Label", 150, 3).where(F.col("Label").isNull()).count() == 5


def test_new_table_sink_refuses_overwrite(spark, tmp_path):
    import pytest
    from gitquarry.sources.catalog import write_new_table
    df = spark.range(3)
    out = str(tmp_path / "labels")
    write_new_table(df, out)
    with pytest.raises(Exception):
        write_new_table(df, out)
    assert spark.read.parquet(out).count() == 3


def test_sql_over_and_preview(spark):
    from gitquarry.sources.catalog import preview, sql_over, sql_with
    df = spark.createDataFrame([("a", "T", "F"), ("b", "T", "T")], "Prefix string, predictedLabel string, Label string")
    q = "SELECT Prefix FROM people WHERE predictedLabel != label"
    assert [r.Prefix for r in sql_over(spark, df, "people", q).collect()] == ["a"]
    assert sql_with(spark, "SELECT count(*) AS n FROM {p}", p=df).first().n == 2
    assert [r.id for r in preview(spark.range(50).repartition(5), 3, F.col("id").desc()).collect()] == [49, 48, 47]


def test_label_sample_round_trip(spark, tmp_path):
    from gitquarry.operators.identity import label_sample
    rows = [(f"p{i}", f"f{i}", "l", f"q{i}", f"f{i}", "l") for i in range(200)]
    pairs = spark.createDataFrame(rows, "Prefix string, Firstname string, Lastname string, "
                                  "Prefix_1 string, Firstname_1 string, Lastname_1 string")
    out = str(tmp_path / "sample")
    sample = label_sample(pairs, out, fraction=0.5, seed=500)
    again = label_sample(pairs, out, fraction=0.5, seed=500, mode="ignore")
    back = read_pairs_csv(spark, out)
    assert back.count() == sample.count() == again.count()
    assert back.where(F.col("Label").isNotNull()).count() == 0


def test_unknown_metrics_are_an_error_and_all_known_ones_stay(spark):
    from gitquarry.operators.models import struct_to_features
    df = spark.sql("SELECT 1L AS _id, 2L AS commit_id, 3L AS file_id, 'class' AS ce_type, 'x' AS long_name, "
                   "named_struct('LOC', 1.0D, 'WMC', 2.0D, 'RFC', 3.0D, 'deep', named_struct('DIT', 4.0D)) AS metrics")
    wanted = [["RID"], ["ProductMetric", "JavaClass"]]
    with pytest.raises(ValueError, match="metrics.RFC"):
        load_logical(df, "code_entity_state", wanted)
    kind = ("ProductMetric", "JavaClass")
    registry = {"code_entity_state": [("_id", ("RID",)), ("metrics.LOC", kind), ("metrics.WMC", kind), ("metrics.RFC", kind),
                                      ("metrics.deep.DIT", kind)]}
    out = load_logical(df, "code_entity_state", wanted, registry)
    assert out.select("metrics.LOC", "metrics.RFC", "metrics.deep.DIT").first() == (1.0, 3.0, 4.0)
    registry["code_entity_state"].remove(("metrics.deep.DIT", kind))
    flat = load_logical(df.withColumn("metrics", F.col("metrics").dropFields("deep")), "code_entity_state", wanted, registry)
    assert struct_to_features(flat, "metrics").first().features.size == 3


CAMEL = [
    '{"_id":{"$oid":"c1"},"committerId":{"$oid":"p1"},"committerDate":{"$date":"2024-01-05T10:00:00.000+0000"},"message":"fix \\"a\\"",'
    '"fileActionIds":[{"$oid":"f1"},{"$oid":"f2"}],"parents":["x","y"],"authorOffset":-60}',
    '{"_id":"c2","committer_id":"p2","committer_date":"2024-02-05T10:00:00Z","message":null}',
    '{"_id":{"$oid":"c3"},"committerId":7,"extra":{"a":1}}', "", "   ", '{"_id":"broken', "[1, 2]", "17", '{"message":"no id"}']


def test_both_generations_become_one_schema(spark):
    docs, dead = parse_documents(spark.createDataFrame([(x,) for x in CAMEL], "line string"), "commit")
    got = {r._id: r for r in docs.collect()}
    assert set(got) == {"c1", "c2", "c3"}
    assert got["c1"].committer_id == "p1" and got["c1"].message == 'fix "a"' and got["c1"].file_action_ids == ["f1", "f2"]
    assert got["c1"].parents == ["x", "y"] and got["c1"].author_offset == -60 and str(got["c1"].committer_date) == "2024-01-05 10:00:00"
    assert got["c2"].committer_id == "p2" and str(got["c2"].committer_date) == "2024-02-05 10:00:00" and got["c2"].message is None
    assert got["c3"].committer_id == "7" and got["c3"].committer_date is None and got["c3"].file_action_ids is None
    assert sorted((r.line, r.reason) for r in dead.collect()) == sorted(
        [('{"_id":"broken', "no document"), ("[1, 2]", "no document"), ("17", "no document"), ('{"message":"no id"}', "no id")])


def test_jobs_run_on_dumps(spark, tmp_path):
    (tmp_path / "commit.json").write_text("\n".join(CAMEL))
    (tmp_path / "file_action.json").write_text("\n".join([
        '{"_id":{"$oid":"f1"},"fileId":{"$oid":"x"},"hunkIds":[{"$oid":"h1"}]}', '{"_id":{"$oid":"f2"},"fileId":{"$oid":"y"},"hunkIds":[]}',
        '{"_id":"f3","file_id":"x","commit_id":"c2"}', "{"]))
    (tmp_path / "hunk.json").write_text('{"_id":{"$oid":"h1"},"newStart":3}\n{"_id":"h2","file_action_id":"f3","new_start":4}')
    (tmp_path / "message.json").write_text('{"_id":{"$oid":"m1"},"fromId":{"$oid":"p1"},"date":{"$date":"2024-01-09T00:00:00.000+0000"}}')
    (tmp_path / "issue_comment.json").write_text('{"_id":"i1","author_id":"p2","created_at":"2024-02-09T00:00:00Z"}')
    cat = Catalog(spark, str(tmp_path), fmt="dump")
    assert sorted((r._id, r.commit_id, r.file_id) for r in cat.load("file_action").collect()) == [("f1", "c1", "x"), ("f2", "c1", "y"), ("f3", "c2", "x")]
    assert sorted((r._id, r.file_action_id, r.new_start) for r in cat.load("hunk").collect()) == [("h1", "f1", 3), ("h2", "f3", 4)]
    assert [r.reason for r in cat.dead_letters("file_action").collect()] == ["no document"]
    got = {tuple(r[c] for c in ("Date", "ID", "messages", "comments", "commits", "bug_fix")) for r in developer_activities(cat).collect()}
    # a commit without a date matches nothing, not even its own flag's count
    assert got == {("2024-01", "p1", 1, None, 1, 1), ("2024-02", "p2", None, 1, 1, 1), (None, "7", None, None, 1, None),
                   (None, "7", None, None, None, 1)}


def test_registry_as_a_table(spark, tmp_path):
    registry_table(spark).write.parquet(f"{tmp_path}/logical_type.parquet")
    registry = Catalog(spark, str(tmp_path)).load("logical_type")
    states = spark.createDataFrame([(1, 2, 3, "class", "n", (1.0, 2.0, 3.0, 4.0))],
                                   "_id int, commit_id int, file_id int, ce_type string, long_name string, metrics struct<LOC:double,WMC:double,CBO:double,NOM:double>")
    for wanted in ([["RID"]], [["ProductMetric"]], [["ProductMetric", "JavaMethod"], ["Name"]]):
        assert load_logical(states, "code_entity_state", wanted, registry).schema == load_logical(states, "code_entity_state", wanted).schema
    with pytest.raises(KeyError):
        load_logical(states, "other", [["RID"]], registry)


def test_a_cluster_needs_the_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Nothing:
        def isDefined(self):
            return False

        def getCheckpointDir(self):
            return self

        def sc(self):
            return self

    class Context:
        master, _jsc = "yarn", Nothing()

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        checkpoint_dir(Session())
