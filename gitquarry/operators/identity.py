"""Identity merging: normalisation (C5), candidate pairs (C6) and pair
features (C7-C9).

Candidate pairs are pairs of person triples (Prefix, Firstname, Lastname)
that agree on some but not all columns ("two_of_three": exactly two;
"one_or_two": one or two), both orders of each pair, no duplicates.

The reference runs three or six self-joins of the raw table and removes
duplicates at the end.  Here the triples are deduplicated first and each
pair is produced by exactly one of three *disjoint* equi-joins, split by
the first equal column:

* Prefix equal;
* Firstname equal, Prefix different;
* Lastname equal, Prefix and Firstname different.

So the triples are listed once under each of their three keys, one join
replaces six and the final ``distinct`` disappears.  The
result is by definition every pair inside a block, so its size is what it
is; what must not happen is one task owning a hot block.  The pairs of keys
whose block yields more than ``hot_pairs`` pairs are dealt over a grid of
cells: left rows to its rows, right rows to its columns.

The same strings meet in many pairs.  ``pair_features`` therefore makes a
dictionary of the distinct unordered pairs of strings, measures each once and
joins the measures back to the pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gitquarry.functions import similarity as S
from gitquarry.operators.sampling import hash_unit, random_split
from gitquarry.sources.catalog import write_csv
from gitquarry.functions.text import (email_local_part, first_name, last_name, letters_only,
                                      not_denylisted)

NAME_COLS = ["Prefix", "Firstname", "Lastname"]
RIGHT_COLS = ["Prefix_1", "Firstname_1", "Lastname_1"]
PAIR_COLS = NAME_COLS + RIGHT_COLS
PAIR_MODES = ("two_of_three", "one_or_two")


# ------------------------------------------------------------------ C5
def normalize_people(people: DataFrame, drop_null: bool = True,
                     drop_empty: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Prefix (e-mail local part), Firstname and Lastname: letters only,
    lower case.  Non-Latin letters vanish and may leave an empty string,
    which stays unless ``drop_empty``; a null input gives null.  Columns in
    ``keep`` follow."""
    out = people.select(
        F.lower(letters_only(email_local_part("email"))).alias("Prefix"),
        F.lower(letters_only(first_name("name"))).alias("Firstname"),
        F.lower(letters_only(last_name("name"))).alias("Lastname"),
        *keep,
    )
    if drop_null:
        out = out.dropna(subset=NAME_COLS)
    if drop_empty:
        out = out.where((F.col("Prefix") != "") & (F.col("Firstname") != "")
                        & (F.col("Lastname") != ""))
    return out


# ------------------------------------------------------------------ C6
def _keys(mode: str) -> list[tuple[str, str]]:
    """The two columns (the same twice: one column) of each blocking key."""
    if mode == "two_of_three":
        return [("Prefix", "Firstname"), ("Prefix", "Lastname"), ("Firstname", "Lastname")]
    return [(c, c) for c in NAME_COLS]


def _first_equal(mode: str) -> Column:
    """Whether a pair that agrees on key ``kind`` belongs to it: no pair
    belongs to two."""
    differ = {c: F.col(c) != F.col(r) for c, r in zip(NAME_COLS, RIGHT_COLS)}
    if mode == "two_of_three":
        parts = [differ["Lastname"], differ["Firstname"], differ["Prefix"]]
    else:
        parts = [differ["Firstname"] | differ["Lastname"], differ["Prefix"], differ["Prefix"] & differ["Firstname"]]
    kind = F.col("_kind")
    return F.when(kind == 0, parts[0]).when(kind == 1, parts[1]).otherwise(parts[2])


def candidate_pairs(persons: DataFrame, mode: str = "two_of_three", hot_pairs: int = 1_000_000) -> DataFrame:
    """J6 / C6 blocking: columns Prefix, Firstname, Lastname, Prefix_1,
    Firstname_1, Lastname_1.  A null in any column excludes the row.

    A block of n triples yields about n*n pairs, all of them part of the
    result.  When that exceeds ``hot_pairs`` the key's pairs are dealt over a
    grid of g x g cells with g = ceil(n / sqrt(hot_pairs)).  A left row
    belongs to one row of the grid and goes to its g cells, a right row to
    one column and its g cells, so each pair meets in exactly one cell, a
    cell holds about ``hot_pairs`` pairs at any n, and a row is replicated
    n / sqrt(hot_pairs) times.  All three keys are counted and joined at once.
    """
    if mode not in PAIR_MODES:
        raise ValueError(f"mode must be one of {PAIR_MODES}")
    t = persons.select(*NAME_COLS).dropna().distinct()
    keys = [F.struct(F.lit(i).alias("_kind"), F.col(a).alias("_a"), F.col(b).alias("_b")) for i, (a, b) in enumerate(_keys(mode))]
    block = ["_kind", "_a", "_b"]
    listed = t.select(*NAME_COLS, F.explode(F.array(*keys)).alias("_key")).select(*NAME_COLS, "_key.*")
    side = hot_pairs ** 0.5
    hot = listed.groupBy(*block).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > side) \
        .select(*block, F.ceil(F.col("_n") / F.lit(side)).cast("bigint").alias("_g"))
    dealt = listed.join(hot, block, "left").withColumn("_g", F.coalesce(F.col("_g"), F.lit(1).cast("bigint"))) \
        .withColumn("_own", F.pmod(F.xxhash64(*NAME_COLS), F.col("_g"))) \
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_g") - 1)))
    left = dealt.select(*NAME_COLS, *block, (F.col("_own") * F.col("_g") + F.col("_other")).alias("_cell"))
    right = dealt.select(*[F.col(c).alias(r) for c, r in zip(NAME_COLS, RIGHT_COLS)], *block,
                         (F.col("_other") * F.col("_g") + F.col("_own")).alias("_cell"))
    return left.join(right, [*block, "_cell"]).where(_first_equal(mode)).select(*PAIR_COLS)


# ------------------------------------------------------------------ C12
def label_sample(pairs: DataFrame, path: str, fraction: float = 0.1, seed: int = 500,
                 mode: str = "errorifexists", single_file: bool = False,
                 split: str = "hash") -> DataFrame:
    """U4 + S4: export a share of the candidate pairs as CSV with header
    for manual labelling (read it back with ``catalog.read_pairs_csv``).
    ``mode="ignore"`` keeps an existing file and continues.  Returns the
    exported sample."""
    sample = random_split(pairs, [fraction, 1 - fraction], seed, method=split, cols=PAIR_COLS)[0]
    write_csv(sample, path, mode=mode, single_file=single_file)
    return sample


def person_label(pairs: DataFrame, records: DataFrame, person_col: str, seed: int = 11,
                 uncertain: float = 0.1, wrong: float = 0.02) -> DataFrame:
    """Label pairs by who wrote them, standing in for the manual labelling
    step: ``T`` when some person (``person_col`` of ``records``, which also have the three
    name columns) has a record with either triple, else ``F``.  As a reader
    would, the label is uncertain (``U``) for a share of the pairs and wrong
    for another, both drawn by the pair's hash.  The names alone do not give
    the label."""
    known = records.select(*NAME_COLS, F.col(person_col).alias("_person")).dropna().distinct()
    other = known.select(*[F.col(c).alias(r) for c, r in zip(NAME_COLS, RIGHT_COLS)], "_person")
    same = known.join(other, "_person").select(*PAIR_COLS, F.lit(True).alias("_same")).distinct()
    u = hash_unit(PAIR_COLS, seed)
    truth = F.coalesce(F.col("_same"), F.lit(False)) != ((u >= uncertain) & (u < uncertain + wrong))
    label = F.when(u < uncertain, "U").when(truth, "T").otherwise("F")
    return pairs.join(same, PAIR_COLS, "left").withColumn("Label", label).drop("_same")


# ------------------------------------------------------------------ C7-C9
def _clean_pairs(pairs: DataFrame) -> DataFrame:
    """P9 + P8: six non-null name columns and a left prefix outside the
    denylist (the right prefix is not checked)."""
    return pairs.dropna(subset=PAIR_COLS).where(not_denylisted("Prefix"))


_SHORT = {"Prefix": "P", "Firstname": "F", "Lastname": "L"}


def pair_dictionary(pairs: DataFrame, slots: Sequence[tuple[str, str]], jw_slots: int, jaccard: bool,
                    jw_variant: str = "lang3") -> DataFrame:
    """The distinct unordered pairs of strings (``lo``, ``hi``) that stand
    in the column pairs ``slots`` of any row, with their measures: ``jw``
    (Jaro-Winkler; of pairs in the first ``jw_slots`` slots) and, for
    ``jaccard``, ``common`` (size of the multiset intersection).  Letters are
    counted once per distinct string."""
    entries = [F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.lit(i < jw_slots).alias("wants_jw"))
               for i, (a, b) in enumerate(slots)]
    words = pairs.select(F.explode(F.array(*entries)).alias("e")).groupBy("e.lo", "e.hi").agg(F.max("e.wants_jw").alias("wants_jw"))
    out = words.select("lo", "hi", S.jaro_winkler(F.when(F.col("wants_jw"), F.col("lo")), "hi", jw_variant).alias("jw"))
    if not jaccard:
        return out
    strings = out.select(F.explode(F.array("lo", "hi")).alias("s")).distinct() \
        .select("s", S.letter_counts("s").alias("letters"), S.other_counts("s").alias("others"))
    one = strings.toDF("lo", "letters_lo", "others_lo")
    two = strings.toDF("hi", "letters_hi", "others_hi")
    return out.join(one, "lo").join(two, "hi") \
        .select("lo", "hi", "jw", S.common_letters("letters_lo", "others_lo", "letters_hi", "others_hi").alias("common"))


def pair_features(pairs: DataFrame, kind: str = "simple", jw_variant: str = "lang3") -> DataFrame:
    """Similarity features of labelled (or unlabelled) pairs.

    * ``simple`` (9): f1-f3 Jaro-Winkler of the same fields, f4-f6
      multiset Jaccard (unrounded), f7-f9 edit-distance ratios.
    * ``broad`` (18): f1-f6 Jaro-Winkler of Prefix and Firstname against
      all three right fields, f7-f9 edit-distance ratios of the same
      fields (they overwrite the last three Jaro-Winkler columns, as in
      the reference), and nine ``XY-Jaccard`` columns rounded half-up to
      two decimals.
    * ``rules`` (16): f1-f9 Jaro-Winkler all-to-all and the name-order
      rules c1-c7.

    Input columns other than the six names (for example ``Label``) are
    kept, and so are repeated rows.  The pairs are exchanged once and read
    twice: for the dictionary of their strings, and to fetch the measures.
    For that a row is listed once per column pair, joined with the dictionary
    and folded again.
    """
    same = list(zip(NAME_COLS, RIGHT_COLS))
    all_to_all = [(a, b) for a in NAME_COLS for b in RIGHT_COLS]
    if kind not in FEATURE_ORDER:
        raise ValueError("kind must be simple, broad or rules")
    slots = same if kind == "simple" else all_to_all
    jw_slots = 6 if kind == "broad" else len(slots)
    df = _clean_pairs(pairs).hint("rebalance")
    names = [F.col(f"`{c}`") for c in df.columns]
    known = pair_dictionary(df, slots, jw_slots, kind != "rules", jw_variant)
    parts = [F.struct(F.lit(i).alias("slot"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")) for i, (a, b) in enumerate(slots)]
    listed = df.select(F.struct(*names).alias("pair"), F.explode(F.array(*parts)).alias("s")).select("pair", "s.slot", "s.lo", "s.hi")
    measures = [c for c in known.columns if c not in ("lo", "hi")]
    fetched = [F.max(F.when(F.col("slot") == i, F.col(m))).alias(f"_{m}_{i}") for i in range(len(slots)) for m in measures]
    rows = listed.join(known, ["lo", "hi"]).groupBy("pair").agg(F.count_if(F.col("slot") == 0).alias("_times"), *fetched)
    rows = rows.select("pair.*", *[f"_{m}_{i}" for i in range(len(slots)) for m in measures],
                       F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int"))).alias("_copy"))
    feats: dict[str, F.Column] = {f"f{i + 1}": F.col(f"_jw_{i}") for i in range(jw_slots)}
    if kind == "simple":
        for i, (a, b) in enumerate(slots):
            feats[f"f{i + 4}"] = S.multiset_jaccard(a, b, False, F.col(f"_common_{i}"))
    if kind in ("simple", "broad"):
        for i, (a, b) in enumerate(same):
            feats[f"f{i + 7}"] = S.edit_ratio(a, b)
    if kind == "broad":
        for i, (a, b) in enumerate(slots):
            feats[f"{_SHORT[a]}{_SHORT[b[:-2]]}-Jaccard"] = S.multiset_jaccard(a, b, True, F.col(f"_common_{i}"))
    if kind == "rules":
        feats.update(S.name_order_rules(*PAIR_COLS))
    return rows.select(*names, *[v.alias(k) for k, v in feats.items()])


# The order in which the learners see the features.
FEATURE_ORDER = {
    "simple": [f"f{i}" for i in range(1, 10)],
    "broad": [f"f{i}" for i in range(1, 10)] + [
        "PP-Jaccard", "PF-Jaccard", "PL-Jaccard", "FF-Jaccard", "FP-Jaccard", "FL-Jaccard",
        "LP-Jaccard", "LF-Jaccard", "LL-Jaccard"],
    "rules": [f"f{i}" for i in range(1, 10)] + [f"c{i}" for i in range(1, 8)],
}
