import contextlib
import datetime as dt
import random

import pytest

from gitquarry.operators.dominance import latest_before_under, span_of
from gitquarry.operators.inducing import fix_to_inducing


def brute_force(commits, fas, hunks, match):
    """The rule, stated per fix: each of its hunks that has an earlier commit
    on its file bounds a region; of all earlier commits inside a region the
    one with the latest date (then the lowest id) is the answer."""
    import re
    pat = re.compile(r"(?i)fix(e[ds])?|bugs?|defects?|patch")
    dates = {cid: d for cid, d, _ in commits}
    fixes = {cid for cid, _, msg in commits if msg and pat.search(msg)}
    place = {fid: (file_id, cid) for fid, file_id, cid in fas}
    touched = [(place[fid][0], place[fid][1], ns) for fid, ns, _, _ in hunks]
    out = {}
    for fix in fixes:
        before = {f: [(dates[c], -c, ns) for g, c, ns in touched if g == f and dates[c] < dates[fix]]
                  for f, _, _ in touched}
        rows = sorted((fid, os_, ol) for fid, _, os_, ol in hunks
                      if place[fid][1] == fix and before[place[fid][0]])
        if not rows:
            continue
        anchor = next((r for r in rows if r[1] != -1), None) if match == "first_hunk" else None
        bounds = [(place[r[0]][0], r[1] + r[2] if anchor is None or r < anchor else anchor[1] + anchor[2])
                  for r in rows]
        inside = [(d, c) for f, bound in bounds for d, c, ns in before[f] if ns <= bound]
        out[fix] = -max(inside)[1] if inside else None
    return out


def _fixture(seed, n_commits=60, n_files=4):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    commits, fas, hunks = [], [], []
    for cid in range(n_commits):
        d = base + dt.timedelta(hours=rnd.randrange(0, 24 * 20, 3))  # ties on dates happen
        msg = rnd.choice(["fix x", "feature", None, "bug y", "docs"])
        commits.append((cid, d, msg))
        for j in range(rnd.choice([1, 1, 2])):
            fid = cid * 10 + j
            fas.append((fid, rnd.randrange(n_files), cid))
            for _ in range(rnd.choice([1, 2, 3])):
                hunks.append((fid, rnd.randrange(0, 40), rnd.choice([-1, rnd.randrange(0, 30)]),
                              rnd.randrange(0, 8)))
    return commits, fas, hunks


@contextlib.contextmanager
def ranges(spark, n):
    """n range partitions, none of them merged."""
    keys = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def jobs_started(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


@pytest.mark.parametrize("n", [1, 5, 40])
def test_matches_brute_force(spark, n):
    """With 40 ranges every file's commits cross several of them."""
    for seed in (1, 2):
        commits, fas, hunks = _fixture(seed)
        cdf = spark.createDataFrame(commits, "_id long, committer_date timestamp, message string")
        fdf = spark.createDataFrame(fas, "_id long, file_id long, commit_id long")
        hdf = spark.createDataFrame(hunks, "file_action_id long, new_start int, old_start int, old_lines int")
        for match in ("first_hunk", "per_hunk"):
            with ranges(spark, n):
                got = {r.fix_commit_id: r.inducing_commit_id for r in fix_to_inducing(cdf, fdf, hdf, match).collect()}
            assert got == brute_force(commits, fas, hunks, match), (seed, match)


def test_building_starts_no_job(spark):
    commits, fas, hunks = _fixture(1)
    cdf = spark.createDataFrame(commits, "_id long, committer_date timestamp, message string")
    fdf = spark.createDataFrame(fas, "_id long, file_id long, commit_id long")
    hdf = spark.createDataFrame(hunks, "file_action_id long, new_start int, old_start int, old_lines int")
    before = jobs_started(spark)
    df = fix_to_inducing(cdf, fdf, hdf)
    assert jobs_started(spark) == before
    df.collect()
    assert jobs_started(spark) > before


def test_exchanges_before_the_large_sorts_are_not_merged(spark):
    """Adaptive execution merges partitions by their compressed size, unless their number is given."""
    commits, fas, hunks = _fixture(1)
    cdf = spark.createDataFrame(commits, "_id long, committer_date timestamp, message string")
    fdf = spark.createDataFrame(fas, "_id long, file_id long, commit_id long")
    hdf = spark.createDataFrame(hunks, "file_action_id long, new_start int, old_start int, old_lines int")
    with ranges(spark, 7):
        plan = fix_to_inducing(cdf, fdf, hdf)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert not any("REPARTITION_BY_COL" in e for e in exchanges)
    assert any("rangepartitioning" in e and ", 7), REPARTITION_BY_NUM" in e for e in exchanges)
    assert sum("hashpartitioning" in e and ", 7), REPARTITION_BY_NUM" in e for e in exchanges) >= 3


@pytest.mark.parametrize("n", [1, 7, 60])
def test_dominance_hot_key(spark, n):
    """One key holds most rows, times and ids tie, and long stretches of
    queries have no predecessor before them in their range."""
    rnd = random.Random(5)
    preds = [(0, float(rnd.randrange(0, 300)), rnd.randrange(0, 100), f"p{i}") for i in range(400)]
    preds += [(1, float(t), rnd.randrange(0, 100), f"o{t}") for t in range(0, 400, 7)] + [(None, 1.0, 1, "x"), (0, None, 1, "y"), (0, 1.0, None, "z")]
    queries = [(i, k, float(rnd.randrange(0, 420)), rnd.choice([-5, 0, 3, 50, 99, 110]))
               for i, k in enumerate([0] * 150 + [1] * 50 + [2] * 5)]
    queries += [(1000 + i, 0, 1000.0 + i, 99) for i in range(200)] + [(2000, None, 5.0, 5), (2001, 0, None, 5), (2002, 0, 5.0, None)]
    queries += [(3000, 0, 50.0, 2), (3000, 0, 80.0, 90), (3000, 1, 300.0, 50)]  # an id that asks three times
    pdf = spark.createDataFrame(preds, "k int, t double, m int, id string")
    qdf = spark.createDataFrame(queries, "qid int, k int, t double, b int")
    with ranges(spark, n):
        rows = latest_before_under(qdf, pdf, ["k"], "t", "b", "m", "id", ["qid"], span_of(pdf, "m")).collect()
    got = {r.qid: (r.latest_key, r.latest_id) for r in rows}
    want = {}
    for qid, k, t, b in queries:
        best = [(pt, pid) for pk, pt, pm, pid in preds if None not in (k, t, b, pk, pt, pm) and pk == k and pt < t and pm <= b]
        want.setdefault(qid, []).extend(best)
    for qid, best in want.items():
        latest = max((t for t, _ in best), default=None)
        assert got[qid] == (latest, min((i for t, i in best if t == latest), default=None))
    assert len(rows) == len(want)


def test_fixture_edge_rows(spark):
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    commits = [  # id, date, message
        (1, day(1), "init"), (2, day(2), "feature"), (3, day(3), "fix bug"), (4, day(4), "FIXED it"),
        (5, day(5), "a"), (6, day(5), "b"), (7, day(6), "patch"),
        (9, day(7), "c"), (10, day(8), "d"), (8, day(9), "defect fix"),
        (11, day(10), "fix"), (13, day(11), "e"), (12, day(12), "fix"),
    ]
    # file actions: id, file, commit
    fas = [(10, "f1", 1), (20, "f1", 2), (30, "f1", 3), (40, "f1", 4), (50, "f2", 5), (60, "f2", 6),
           (70, "f2", 7), (80, "f3", 8), (81, "f3", 8), (82, "f4", 8), (90, "f3", 9), (100, "f4", 10),
           (110, "f5", 11), (130, "f6", 13), (120, "f6", 12)]
    # hunks: file action, new_start, old_start, old_lines
    hunks = [(10, 10, 0, 0), (20, 15, 0, 0), (30, 20, 10, 5), (40, 0, 10, 4),
             (50, 1, 0, 0), (60, 1, 0, 0), (70, 0, 0, 100),
             (90, 30, 0, 0), (100, 40, 0, 0), (80, 0, -1, 3), (81, 0, 50, 0), (82, 0, -1, 1),
             (110, 0, 1, 1), (130, 100, 0, 0), (120, 0, 5, 0)]
    cdf = spark.createDataFrame(commits, "_id long, committer_date timestamp, message string")
    fdf = spark.createDataFrame(fas, "_id long, file_id string, commit_id long")
    hdf = spark.createDataFrame(hunks, "file_action_id long, new_start int, old_start int, old_lines int")
    got = {m: {r.fix_commit_id: r.inducing_commit_id for r in fix_to_inducing(cdf, fdf, hdf, m).collect()}
           for m in ("first_hunk", "per_hunk")}
    # 3: predecessor exactly on old_start + old_lines counts; 4: one line beyond does not
    # 7: two predecessors on the same date -> lowest id; 11: no predecessor -> absent
    # 12: predecessors but none in the region -> null
    # 8: the -1 hunk after the anchor is tested against the anchor (first_hunk) or itself
    assert got["first_hunk"] == {3: 2, 4: 1, 7: 5, 8: 10, 12: None}
    assert got["per_hunk"] == {3: 2, 4: 1, 7: 5, 8: 9, 12: None}
    for m in ("first_hunk", "per_hunk"):
        assert brute_force(commits, fas, hunks, m) == got[m]


def test_wall_clock_times_in_a_daylight_saving_gap(spark):
    """timestamp_ntz values keep their calendar order whatever the session
    time zone: 02:30 on the spring-forward night does not exist in New
    York, yet it comes before 03:10."""
    old_tz = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        commits = spark.createDataFrame(
            [(1, "2024-03-10 02:30:00", "a"), (2, "2024-03-10 03:10:00", "b"),
             (3, "2024-03-10 03:20:00", "fix")], "_id long, t string, message string") \
            .selectExpr("_id", "CAST(t AS TIMESTAMP_NTZ) AS committer_date", "message")
        # the fix touches two files; file x last changed at 02:30, file y at 03:10
        fas = spark.createDataFrame([(10, "x", 1), (20, "y", 2), (30, "x", 3), (31, "y", 3)],
                                    "_id long, file_id string, commit_id long")
        hunks = spark.createDataFrame([(10, 1, 0, 0), (20, 1, 0, 0), (30, 0, 5, 5), (31, 0, 5, 5)],
                                      "file_action_id long, new_start int, old_start int, old_lines int")
        got = {r.fix_commit_id: r.inducing_commit_id
               for r in fix_to_inducing(commits, fas, hunks, "per_hunk").collect()}
        assert got == {3: 2}
        # the earlier wall-clock predecessor alone is still found
        only_x = fix_to_inducing(commits, fas.where("file_id = 'x'"), hunks, "per_hunk").collect()
        assert [(r.fix_commit_id, r.inducing_commit_id) for r in only_x] == [(3, 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old_tz)
