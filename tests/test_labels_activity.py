import datetime as dt


from gitquarry.functions.text import BUGFIX_PATTERN
from gitquarry.operators.activity import developer_activity
from gitquarry.operators.labels import label_bugfix


def test_bugfix_pattern_edge_rows(spark):
    msgs = [(1, "Fixed the parser"), (2, None), (3, "prefix handling"), (4, "FIXED NPE"),
            (5, "Merge branch\n\nfeature"), (6, "add dispatch table"), (7, "bugs in UI"),
            (8, "docs only"), (9, "defect 12"), (10, "apply patch"), (11, "fixes #3")]
    df = spark.createDataFrame(msgs, "_id int, message string").selectExpr("*", "0 AS vcs_system_id")
    got = {r._id: r.bugfix for r in label_bugfix(df).collect()}
    assert got == {1: True, 2: None, 3: True, 4: True, 5: False, 6: True, 7: True, 8: False,
                   9: True, 10: True, 11: True}
    assert BUGFIX_PATTERN == "(?i)fix(e[ds])?|bugs?|defects?|patch"


def test_project_restriction_is_semi_join(spark):
    commits = spark.createDataFrame([(1, 10, "fix"), (2, 11, "x"), (3, 12, "bug")],
                                    "_id int, vcs_system_id int, message string")
    vcs = spark.createDataFrame([(10, 1), (11, 2), (12, 1)], "_id int, project_id int")
    projects = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "alps")], "_id int, name string")
    out = label_bugfix(commits, projects=projects, vcs_systems=vcs, project_like="al%")
    assert sorted(r._id for r in out.collect()) == [1, 3]


def test_activity_keeps_flag_rows_and_null_actors(spark):
    t = dt.datetime(2024, 3, 5, 10)
    commits = spark.createDataFrame(
        [(1, 7, t, "fix a"), (2, 7, t, "feature"), (3, None, t, "bug")],
        "_id int, committer_id int, committer_date timestamp, message string")
    messages = spark.createDataFrame([(7, t), (None, t)], "from_id int, date timestamp")
    comments = spark.createDataFrame([(8, t)], "author_id int, created_at timestamp")
    rows = developer_activity(messages, comments, commits).collect()
    seven = sorted((r.bug_fix, r.commits, r.messages) for r in rows if r.ID == 7)
    assert seven == [(1, 2, 1), (1, 2, 1)]  # one row per flag value, commits repeated
    nulls = [r for r in rows if r.ID is None]
    assert len(nulls) == 3  # messages, commits and flag counts: nulls never match
    only = developer_activity(messages, comments, commits, bugfix_only=True).collect()
    assert sorted((r.bug_fix, r.commits) for r in only if r.ID == 7) == [(1, 2)]
    assert [r.comments for r in rows if r.ID == 8] == [1]
