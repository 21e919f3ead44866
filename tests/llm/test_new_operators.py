"""Byte-level BPE, periodic runs and ranked search against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from gitquarry.llm import bpe, lexical, periodic
from gitquarry.llm.queries import BYTE_RANKS, QUERIES, with_planted_periods
from tests.llm.corpus import documents, texts, words
from tests.llm.test_scans import alnum

RANKS = bpe.read_ranks(BYTE_RANKS)
WHOLE = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
LETTERS = "aaabbb  xxXX'slt're'll 0123 \n\n\t  \r\n!!..é漢\U0001F600　 thetheing"


def odd_text(r, most=120):
    some = [r.choice(LETTERS) for _ in range(r.choice([1, 2, 4, 60]))]
    return "".join(r.choice(some) for _ in range(r.randrange(most)))


@pytest.mark.parametrize("leaf, piece_leaf", [(1, 1), (3, 2), (7, 5), (2048, 128)])
def test_tree_equals_the_whole_encoding(leaf, piece_leaf):
    """Leaves of one character and one byte leave all the work to the joins."""
    r, codec = random.Random(leaf), bpe.Codec(RANKS, public_tokenizers.PATTERN, leaf, piece_leaf, most=300)
    for text in [odd_text(r) for _ in range(800)] + ["x" * 3000, "ab" * 1000, " " * 999, "the" * 500, "é" * 700]:
        part = codec.encode(text)
        ids = np.frombuffer(part.ids, "<u4").tolist()
        assert ids == WHOLE.encode_ordinary(text)
        assert part.sizes.sum() == len(ids) and codec.decode(part.ids) == text.encode()


def test_join_is_associative():
    r, codec = random.Random(5), bpe.Codec(RANKS, public_tokenizers.PATTERN, 4, 4)
    for _ in range(300):
        a, b, c = (codec.encode(odd_text(r, 40)) for _ in range(3))
        assert codec.join(codec.join(a, b), c).ids == codec.join(a, codec.join(b, c)).ids


@pytest.mark.parametrize("segment", [7, 500, bpe.SEGMENT])
def test_encoding_in_segments(spark, segment):
    r = random.Random(4)
    df, rows = documents(spark, [odd_text(r) for _ in range(40)] + texts(12, 8)[:12] + ["x" * 3000, "\n" * 700 + "a"], clashing=True)
    df = df.withColumn("ids", F.lit(1)).withColumn("row_key", F.lit(2))
    got = bpe.encode(df, BYTE_RANKS, public_tokenizers.PATTERN, segment=segment)
    back = bpe.decode(got, BYTE_RANKS, public_tokenizers.PATTERN).collect()
    have = collections.Counter((x.doc_id, tuple(np.frombuffer(x.ids, "<u4").tolist()), bytes(x.decoded)) for x in back)
    assert have == collections.Counter((d, tuple(WHOLE.encode_ordinary(t or "")), (t or "").encode()) for d, t, *_ in rows)
    assert bpe.encode(df.limit(0), BYTE_RANKS, public_tokenizers.PATTERN, segment=segment).count() == 0


def test_op11_query(spark, tmp_path):
    df, rows = documents(spark, texts(21, 20))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = collections.Counter()
    for d, t, *_ in rows:
        ids = WHOLE.encode_ordinary(t or "")
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, QUERIES["op11_monoid_tree_bpe"](spark, str(tmp_path)).collect())) == want


def slow_runs(w, min_length=6, min_exponent=4):
    same = []
    for q in range(1, len(w) // min_exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i:
                same.append((i, j - i + q, q))
            i = j + 1
    return sorted(((s, n, q) for s, n, q in same if n >= max(min_length, min_exponent * q)
                   and not any(p < q and a <= s and a + m >= s + n for a, m, p in same)), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("min_length, min_exponent", [(6, 4), (2, 3), (20, 4), (7, 5), (13, 3)])
def test_runs(min_length, min_exponent):
    r = random.Random(min_length)
    for _ in range(250):
        docs = []
        for _ in range(r.randrange(1, 5)):
            n, k = r.randrange(60), r.choice([1, 2, 3, 6])
            w = [b"%d" % r.randrange(k) for _ in range(n)]
            if n and r.random() < 0.6:
                a, p = r.randrange(n), r.randrange(1, 12)
                w = [w[i] if i < a else w[min(n - 1, a + (i - a) % p)] for i in range(n)]
            docs.append(w)
        assert periodic.runs_of(docs, min_length, min_exponent) == [slow_runs(w, min_length, min_exponent) for w in docs]


def test_a_word_said_very_often_is_one_run():
    assert periodic.runs_of([[b"again"] * 100_000, [], [b"again"] * 5]) == [[(0, 100_000, 1)], [], []]
    assert periodic.collapsed([b"a", b"b", b"b", b"b", b"b", b"b", b"b", b"c"], [(1, 6, 1)]) == b"a b c"


def planted(doc_id, t):
    w = re.findall("[^\x20\x09-\x0d]+", t or "")
    if doc_id is not None and w and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_op12_query(spark, tmp_path):
    df, rows = documents(spark, texts(31, 80))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = collections.Counter()
    for d, t, *_ in rows:
        w = planted(d, t)
        runs = slow_runs(w) if len(w) < 400 else periodic.runs_of([[x.encode() for x in w]])[0]
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2])) if runs else (None, None, None)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want[d, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
             hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
             hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()] += 1
    got = QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()
    assert collections.Counter(map(tuple, got)) == want
    assert sum(r.n_runs > 0 for r in got) > 5


def test_periodic_clashing_and_empty(spark):
    df, rows = documents(spark, ["a b " * 5, None, ""], clashing=True)
    df = df.withColumn("runs", F.lit(1)).withColumn("row.key", F.lit(3))
    got = periodic.find(df).collect()
    assert sorted((r.n_words, r.collapsed, len(r.runs)) for r in got if r.n_words) == [(10, "a b", 1)] and len(got) == len(rows)
    assert with_planted_periods(df).count() == len(rows)
    assert periodic.find(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.find(df, min_exponent=2)


def slow_search(rows, items, top):
    tf = [(r[0], collections.Counter(alnum(r[1]))) for r in rows]
    n_docs, n_terms = sum(bool(c) for _, c in tf), sum(sum(c.values()) for _, c in tf)
    df = collections.Counter(t for _, c in tf for t in c)
    out = []
    for item, text in dict.fromkeys((i, t or "") for i, t in items):
        found = []
        for doc, c in tf:
            m = 75 + 25 * sum(c.values()) * n_docs // max(1, n_terms)
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                        for t, r in collections.Counter(alnum(text)).items() if t in c)
            if score > 0:
                found.append((-score, -1 if doc is None else doc, doc))
        out += [(item, i + 1, doc, -s) for i, (s, _, doc) in enumerate(sorted(found, key=lambda x: x[:2])[:top])]
    return collections.Counter(out)


@pytest.mark.parametrize("top, block_terms", [(20, lexical.BLOCK_TERMS), (3, 40), (1000, 200)])
def test_search(spark, top, block_terms):
    found = texts(41, 60)
    items = [(i, " ".join(words(500 + i % 7, 25)[i % 3:])) for i in range(20)]
    items += [(100, "the the THE of"), (101, None), (102, "!?"), (103, "zzz-unknown"), (None, "w7 w8"), (5, "w1 w2"), (5, "w1 w2")]
    df, rows = documents(spark, found, clashing=True)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("terms", F.lit(1)).withColumn("rank", F.lit(2))
    got = lexical.search(df, bench, top=top, block_terms=block_terms).collect()
    assert collections.Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == slow_search(rows, items, top)


def test_search_of_empty_tables(spark):
    df, _ = documents(spark, ["a b", None], nulls=False)
    bench = spark.createDataFrame([("x", "a")], "item_id string, text string")
    assert lexical.search(df.limit(0), bench).count() == 0
    assert lexical.search(df, bench.limit(0)).count() == 0
    assert [(r.item_id, r["rank"]) for r in lexical.search(df, bench).collect()] == [("x", 1)]


def test_items_share_nodes():
    """A set that many items hold becomes one node; every item stays the sum of its leaves."""
    r = random.Random(8)
    common = [(b"t%d" % i, 1) for i in range(12)]
    items = [common + [(b"own%d_%d" % (i, j), r.randrange(1, 3)) for j in range(r.randrange(6))] for i in range(30)]
    graph = lexical.mine(items)

    def leaves(node):
        if node < len(graph.leaves):
            return [graph.leaves[node]]
        node -= len(graph.leaves)
        assert max(graph.left[node], graph.right[node]) < node + len(graph.leaves)
        return leaves(graph.left[node]) + leaves(graph.right[node])

    for item, nodes in zip(items, graph.items):
        assert sorted(x for n in nodes for x in leaves(n)) == sorted(item)
        assert any(set(common) <= set(leaves(n)) for n in nodes)
    adds = len(graph.left) + sum(map(len, graph.items))
    assert adds < sum(map(len, items)) / 2
