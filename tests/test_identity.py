import collections
import itertools
import random

import pytest

from gitquarry.functions.similarity import jaro_winkler_lang3, jaro_winkler_standard
from gitquarry.operators.identity import (NAME_COLS, PAIR_COLS, RIGHT_COLS, candidate_pairs, normalize_people, pair_dictionary,
                                          pair_features)


@pytest.mark.parametrize("a,b,expected", [
    ("frog", "fog", 0.93), ("fly", "ant", 0.0), ("elephant", "hippo", 0.44),
    ("hippo", "elephant", 0.44), ("hippo", "zzzzzzzz", 0.0), ("hello", "hallo", 0.88),
    ("ABC Corporation", "ABC Corp", 0.93), ("D N H Enterprises Inc", "D & H Enterprises, Inc.", 0.95),
    ("My Gym Children's Fitness Center", "My Gym. Childrens Fitness", 0.92),
    ("PENNSYLVANIA", "PENNCISYLVNIA", 0.88), ("", "", 0.0),
])
def test_jaro_winkler_library_values(a, b, expected):
    assert jaro_winkler_lang3(a, b) == expected


def test_normalize_edge_rows(spark):
    rows = [(1, "Zed Quill", "zed.quill@x.org", "u"), (2, None, "a@b", "u"),
            (3, "  Mora  Tarn ", "mora", "u"), (4, "Émile Zoë", "12@x", "u"),
            (5, "Solo", None, "u"), (6, "   ", "s@x", "u")]
    df = spark.createDataFrame(rows, "_id int, name string, email string, username string")
    got = sorted(tuple(r) for r in normalize_people(df).collect())
    assert got == sorted([("zedquill", "zed", "quill"), ("mora", "", "tarn"),
                          ("", "mile", "zo"), ("s", "", "")])


def _brute_pairs(triples, mode):
    out = set()
    for a, b in itertools.product(triples, repeat=2):
        if any(x is None for x in a + b):
            continue
        eq = sum(x == y for x, y in zip(a, b))
        if (mode == "two_of_three" and eq == 2) or (mode == "one_or_two" and eq in (1, 2)):
            out.add(a + b)
    return out


def test_candidate_pairs_match_brute_force_and_are_symmetric(spark):
    vals = ["a", "b", ""]
    triples = [(p, f, l) for p in vals for f in vals for l in vals][::2] + [("a", None, "b")]
    triples += triples[:5]  # duplicates
    df = spark.createDataFrame(triples, "Prefix string, Firstname string, Lastname string")
    for mode in ("two_of_three", "one_or_two"):
        for hot in (1_000_000, 9, 1):  # hot_pairs=1 gives each pair of a key its own cell
            got = [tuple(r) for r in candidate_pairs(df, mode, hot_pairs=hot).collect()]
            assert len(got) == len(set(got))
            assert set(got) == _brute_pairs(triples, mode)
            assert {g[3:] + g[:3] for g in got} == set(got)


def test_features_are_symmetric_and_filter_denylist(spark):
    pairs = [("zedq", "zed", "quill", "quill", "zed", "quill"),
             ("quill", "zed", "quill", "zedq", "zed", "quill"),
             ("loguser", "a", "b", "x", "a", "b"),       # left prefix denylisted: dropped
             ("mora", "a", "b", "mailinglist", "a", "b"),  # right prefix only: kept
             ("tarn", None, "b", "x", "a", "b")]           # null field: dropped
    df = spark.createDataFrame(pairs, ",".join(f"{c} string" for c in PAIR_COLS))
    rows = [r for r in pair_features(df, "broad").collect()]
    assert sorted(r.Prefix for r in rows) == ["mora", "quill", "zedq"]
    r0, r1 = sorted((r for r in rows if r.Prefix != "mora"), key=lambda r: r.Prefix)
    assert r0["PP-Jaccard"] == r1["PP-Jaccard"]
    assert r0["f7"] == r1["f7"] and r0["f8"] == 1.0
    rules = {r.Prefix: r for r in pair_features(df, "rules").collect()}
    assert rules["quill"].c2 is False and rules["zedq"].c1 is False


def test_vectorised_jaro_winkler_equals_scalar():
    import random

    import numpy as np

    from gitquarry.functions.similarity import (jaro_winkler_many, jaro_winkler_standard)
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    words += ["".join(rnd.choice("ab") for _ in range(rnd.randint(60, 80))) for _ in range(20)]
    a = [rnd.choice(words) for _ in range(5000)] + [None, "x", "été", "a\x00"]
    b = [rnd.choice(words) for _ in range(5000)] + ["x", None, "ete", "a"]
    for variant, fn in (("lang3", jaro_winkler_lang3), ("standard", jaro_winkler_standard)):
        got = jaro_winkler_many(a, b, variant)
        for x, y, g in zip(a, b, got):
            if x is None or y is None:
                assert np.isnan(g)
            else:
                assert g == fn(x, y), (x, y)


def test_standard_variant_matches_duckdb():
    import random

    import duckdb
    import numpy as np
    import pandas as pd

    from gitquarry.functions.similarity import jaro_winkler_many
    rnd = random.Random(21)
    words = ["".join(rnd.choice("abcdeghilmnorst") for _ in range(rnd.randint(1, 12)))
             for _ in range(400)]
    df = pd.DataFrame([(rnd.choice(words), rnd.choice(words)) for _ in range(5000)],
                      columns=["a", "b"])
    con = duckdb.connect()
    con.register("p", df)
    expected = np.array([r[0] for r in con.execute(
        "SELECT jaro_winkler_similarity(a, b) FROM p").fetchall()])
    got = jaro_winkler_many(df.a.tolist(), df.b.tolist(), "standard")
    assert np.max(np.abs(expected - got)) < 1e-12


def test_similarities_are_the_same_in_both_orders():
    r = random.Random(4)
    for _ in range(20_000):
        a, b = ("".join(r.choice("abcde") for _ in range(r.randrange(12))) for _ in range(2))
        assert jaro_winkler_lang3(a, b) == jaro_winkler_lang3(b, a)
        assert jaro_winkler_standard(a, b) == jaro_winkler_standard(b, a)


def _odd_pairs():
    r = random.Random(6)
    names = ["".join(r.choice("abcdé\U0001F600-") for _ in range(r.randrange(6))) for _ in range(12)]
    rows = [tuple(r.choice(names) for _ in range(6)) + (r.choice(["T", "F"]),) for _ in range(150)]
    return rows + rows[:9]  # repeated rows stay


@pytest.mark.parametrize("kind", ["simple", "broad", "rules"])
def test_each_string_pair_is_measured_once(spark, kind):
    rows = _odd_pairs()
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in [*PAIR_COLS, "Label"]))
    slots = [(a, b) for a in NAME_COLS for b in RIGHT_COLS] if kind != "simple" else list(zip(NAME_COLS, RIGHT_COLS))
    at = {c: i for i, c in enumerate(PAIR_COLS)}
    want = {tuple(sorted((x[at[a]], x[at[b]]))) for x in rows for a, b in slots}
    known = pair_dictionary(df, slots, len(slots), kind != "rules").collect()
    assert len(known) == len(want) and {(k.lo, k.hi) for k in known} == want
    assert all(k.jw == jaro_winkler_lang3(k.lo, k.hi) for k in known)

    feats = pair_features(df, kind)
    got = feats.collect()
    assert sorted(tuple(g[:7]) for g in got) == sorted(rows)
    plan = feats._jdf.queryExecution().executedPlan().toString()
    assert "array_position" not in plan and "isFinalPlan=true" in plan
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("ArrowEvalPython") == 1
    for g in got:
        for i, (a, b) in enumerate(slots[:6 if kind == "broad" else 9]):
            assert g[f"f{i + 1}"] == jaro_winkler_lang3(g[a], g[b]) or (kind == "broad" and i >= 6)
        if kind != "rules":
            for i, (a, b) in enumerate(slots):
                common = sum((collections.Counter(g[a]) & collections.Counter(g[b])).values())
                n = len(g[a]) + len(g[b]) - common
                value = g[f"f{i + 4}"] if kind == "simple" else g[f"{a[0]}{b[0]}-Jaccard"]
                assert value == (None if n == 0 else common / n if kind == "simple" else (200 * common + n) // (2 * n) / 100)
