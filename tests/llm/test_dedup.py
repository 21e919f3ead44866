"""Exact, near and substring de-duplication against brute force."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from gitquarry.llm import exact_dedup, simhash, substring_dedup
from gitquarry.llm.common import run_hashes, word_hashes
from tests.llm.corpus import documents, texts


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


@pytest.mark.parametrize("hash_bits", [64, 6])
def test_exact_dedup(spark, hash_bits):
    """With a hash of 6 bits most blocks clash, and names must still tell texts apart."""
    df, rows = documents(spark, texts(2), clashing=True)
    got = exact_dedup.assign(df, block_bytes=64, hash_bits=hash_bits).collect()
    groups = collections.defaultdict(list)
    for doc_id, t, *_ in rows:
        groups[lower(t)].append(doc_id)
    want = collections.Counter()
    for doc_id, t, *_ in rows:
        same = groups[lower(t)]
        keep = max((d for d in same if d is not None), default=None)
        want[doc_id, keep, len(same), doc_id == keep, hashlib.sha256(lower(t).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_exact_dedup_keeps_rows_and_columns(spark):
    df, rows = documents(spark, ["a b", "A B", "c", None, ""], clashing=True, nulls=False)
    got = exact_dedup.keep_one(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [3, 6, 12]
    assert exact_dedup.keep_one(df.limit(0)).count() == 0


def slow_fingerprint(t, n=3):
    w = re.findall("[^\x20\x09-\x0d]+", lower(t))
    grams = [" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(values, radius):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in itertools.combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= radius:
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("tile", [4, 2048])
def test_simhash_groups(spark, tile):
    df, rows = documents(spark, texts(3), clashing=True)
    got = simhash.near_duplicates(df, tile=tile).collect()
    fps = [slow_fingerprint(t) for _, t, *_ in rows]
    groups = slow_groups(fps, 3)
    least = {g: min((r[0] for r, h in zip(rows, groups) if h == g and r[0] is not None), default=None) for g in groups}
    want = collections.Counter((r[0], f"{fp:016x}", least[g]) for r, fp, g in zip(rows, fps, groups))
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


@pytest.mark.parametrize("radius", [0, 1, 3, 4])
def test_bit_slices(radius):
    r = random.Random(radius)
    base = [r.getrandbits(64) for _ in range(20)]
    values = np.array([b ^ sum({1 << r.randrange(64) for _ in range(r.randrange(7))}) for b in base for _ in range(8)], np.uint64)
    i, j = simhash.close_pairs(values, values[:90], radius)
    assert set(zip(i.tolist(), j.tolist())) == {
        (a, b) for a in range(len(values)) for b in range(90) if (int(values[a]) ^ int(values[b])).bit_count() <= radius}
    near = simhash.close_lists(values[:100], values[60:160], radius)
    assert near.tolist() == [k for k in range(100) if (int(values[k]) ^ int(values[60 + k])).bit_count() <= radius]


@pytest.mark.parametrize("tile", [8, 64, 2048])
def test_dense_ball_stays_linked(spark, tile):
    """Many fingerprints around one centre: a group of its own size, in tiles of any size, with few links."""
    centre, r = 0x0123456789ABCDEF, random.Random(1)
    values = sorted({centre ^ (1 << i) ^ (1 << j) for i in range(40) for j in range(i)} | {r.getrandbits(64) for _ in range(50)})
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    links = simhash.links(fps, tile=tile)
    unsigned = lambda x: x % (1 << 64)
    assert all((unsigned(r.u) ^ unsigned(r.v)).bit_count() <= 64 for r in links.collect())
    roots = {unsigned(r.node): unsigned(r.root) for r in simhash.groups(links).collect()}
    groups = slow_groups(values, 3)
    same = collections.defaultdict(set)
    for v, g in zip(values, groups):
        same[g].add(roots.get(v, v))
    assert all(len(x) == 1 for x in same.values()) and len(same) == len({next(iter(x)) for x in same.values()})


def test_long_chain_is_one_group(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in simhash.groups(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500}


def test_simhash_keeps_one_of_each_group(spark):
    df, rows = documents(spark, texts(4), clashing=True, nulls=False)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    groups = slow_groups([slow_fingerprint(t) for _, t, *_ in rows], 3)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(r[0] for r, h in zip(rows, groups) if h == g) for g in set(groups))
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def slow_repeats(rows, window):
    """Words left of each (doc_id, text), by comparing every window."""
    split = sorted({(r[0] if r[0] is not None else -(1 << 63), r[1]) for r in rows}, key=lambda x: (x[0], x[1] or ""))
    first, out = {}, {}
    for doc, t in split:
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        gone = set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            if key in first:
                gone |= set(range(i, i + window))
            else:
                first[key] = (doc, i)
        out[doc, t] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize(("window", "anchor", "buffer_rows"), [(20, 8, 400_000), (20, 8, 7), (5, 2, 11), (4, 4, 50), (6, 1, 1000)])
def test_substring_dedup(spark, window, anchor, buffer_rows):
    df, rows = documents(spark, texts(5, 40), clashing=True)
    got = substring_dedup.without_repeats(df, window=window, anchor=anchor, buffer_rows=buffer_rows).collect()
    want = slow_repeats(rows, window)
    expected = collections.Counter((r[0], *want[r[0] if r[0] is not None else -(1 << 63), r[1]]) for r in rows)
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == expected


def test_substring_dedup_empty(spark):
    df, _ = documents(spark, ["a b c"], nulls=False)
    assert substring_dedup.without_repeats(df.limit(0)).count() == 0


def test_equal_windows_pick_equal_anchors():
    w = [f"w{i % 17}".encode() for i in range(300)]
    hashes, first, offset, n, windows = substring_dedup.stretches(word_hashes(w), 20, 8)
    picked = {}
    for h, f, o, k in zip(hashes.tolist(), first.tolist(), offset.tolist(), n.tolist()):
        for i in range(k):
            picked.setdefault(int(windows[f + i]), set()).add((h, o - i))
    assert sum(n.tolist()) == 281 and all(len(x) == 1 for x in picked.values())
    assert len(run_hashes(word_hashes(w), 301)) == 0


def test_numbered_orders_rows_and_merges_small_ranges(spark):
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        out = exact_dedup.numbered(spark.range(5000).selectExpr("pmod(id * 7919, 50) AS left", "id AS right"), ["left", "right"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    found = sorted((r.name, r.left, r.right) for r in out.collect())
    assert len({name for name, _, _ in found}) == 5000
    assert [r[1:] for r in found] == sorted((i * 7919 % 50, i) for i in range(5000))
    assert len(out.inputFiles()) < 10
