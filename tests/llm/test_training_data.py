"""Packing, web archives, toxicity and the pipeline."""

import collections
import gzip
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gitquarry.llm import packing, toxicity, warc
from gitquarry.llm.queries import VOCABULARY
from tests.llm.corpus import documents, texts, words
from tests.llm.test_dedup import slow_fingerprint, slow_groups
from tests.llm.test_scans import alnum, slow_contamination


def test_piece_tokens_equal_the_tokenisers():
    r = random.Random(3)
    letters = "abcABC ÀÉßµªº²½×÷' 's're'll'd!!$$&*.,<|endoftext|><|İ́Å　 \x1c\x1d\x85\x0b\t\n09ſΣς漢字é한\U0001F600‍­\x01\x7f"
    some = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(3000)] + [t or "" for t in texts(8)]
    some += ["<|endoftext|>", "a<|endoftext|>b", "<|startoftext|> x"]
    whole, mine = Tokenizer.from_file(VOCABULARY), packing.PieceTokens(VOCABULARY, most=500)
    for i in range(0, len(some), 50):
        part = some[i:i + 50]
        for ids, e in zip(mine.encode([t.encode() for t in part]), whole.encode_batch(part, add_special_tokens=False)):
            assert ids.tolist() == e.ids


@pytest.mark.parametrize("capacity", [8, 64, 2048])
def test_packing_is_an_exact_round_trip(spark, capacity):
    df, rows = documents(spark, texts(9), clashing=True)
    got = packing.pack(df, VOCABULARY, capacity=capacity).collect()
    whole = Tokenizer.from_file(VOCABULARY)
    want = collections.Counter((d, tuple(whole.encode(t or "", add_special_tokens=False).ids + [1])) for d, t, *_ in rows)
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, ids, r.doc_tokens))
    for own in sequences.values():
        assert [o for o, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1]]
        total = sum(n for _, n in own)
        assert total <= capacity and (total == capacity or total & (total - 1) == 0)
    lists = collections.Counter()
    for d, own in pieces.items():
        times = sum(n for (x, _), n in want.items() if x == d)
        if times > 1:  # a doc_id listed again: each id as often as it occurs
            assert sum(len(i) for _, i, _ in own) == sum(len(t) * n for (x, t), n in want.items() if x == d)
            continue
        ids = []
        for start, part, n in sorted(own):
            assert start == len(ids)
            ids += part
        assert {n for *_, n in own} == {len(ids)}
        lists[d, tuple(ids)] += 1
    assert lists == collections.Counter({k: n for k, n in want.items() if sum(m for (x, _), m in want.items() if x == k[0]) == 1})
    assert packing.pack(df.limit(0), VOCABULARY).count() == 0


def test_bins_hold_a_fixed_number_of_documents():
    r, packer = random.Random(1), packing.Packer(128, 8)
    lengths = [r.randrange(1, 400) for _ in range(500)]
    found = [s for k, n in enumerate(lengths) for s in packer.add(k, np.arange(n))]
    assert all(sum(len(p[2]) for p in s) == 128 for s in found)
    found += list(packer.end())
    ids = collections.defaultdict(list)
    for s in found:
        for key, start, part in s:
            ids[key].append((start, part.tolist()))
    assert all([x for _, p in sorted(ids[k]) for x in p] == list(range(n)) for k, n in enumerate(lengths))


def page_rows():
    r = random.Random(2)
    big = ["<p>" + " ".join(words(i, 400)) + "</p>\r\n\r\nWARC/1.1\r\n" for i in range(4)]
    rows = [(i, f"http://x/{i} é\n", r.choice([*big, "small", "é" * 499, "é" * 500, "", None])) for i in range(80)]
    return rows + [(None, None, big[0]), (200, "u", big[1]), (200, "u", big[1]), (7000, "u", "\U0001F600" * 100_000)]


def test_warc_round_trip(spark, tmp_path):
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha256", F.lit(1)).withColumn("response", F.lit(1)).repartition(3)
    warc.write_monolithic(pages, f"{tmp_path}/crawl")
    warc.normalise(spark, f"{tmp_path}/crawl", f"{tmp_path}/normal")
    size = {r: len((r[2] or "").encode()) for r in rows}
    last = {}
    for page_id, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if page_id is None else page_id)
    want = collections.Counter()
    for r in rows:
        payload = (r[2] or "").encode()
        again = size[r] >= 1000 and last[r[2] or ""] not in (r[0], -1)
        want[None if r[0] is None else r[0], len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", last[r[2] or ""] if again else None] += 1
    for folder, names in (("crawl", "*.gz"), ("normal/archive", "part-*")):
        back = warc.read(spark, f"{tmp_path}/{folder}", names=names).select(
            warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "type", warc.page_of("refers_to").alias("refers_to"), "payload").collect()
        assert collections.Counter(tuple(r)[:5] for r in back) == want
        assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in back if r.type == "response")
    # any record can be read alone, by the index; a plain gzip reader reads the whole file
    index = collections.defaultdict(list)
    for r in spark.read.parquet(f"{tmp_path}/normal/index").collect():
        index[r.file].append(r)
    assert sum(map(len, index.values())) == len(rows)
    for name, own in index.items():
        content = (tmp_path / "normal/archive" / name).read_bytes()
        assert gzip.decompress(content).count(b"WARC-Record-ID") == len(own)
        for r in own:
            raw = zlib.decompress(content[r.offset:r.offset + r.length], 31)
            assert raw.startswith(b"WARC/1.1\r\n") and r.record_id.encode() in raw and raw.endswith(b"\r\n\r\n")


def test_broken_archives_are_refused(spark, tmp_path):
    whole = gzip.compress(warc.record("response", "1", "u", b"abc") + b"\r\n\r\n")
    assert [r.block for r in warc.parse(whole)] == [b"abc"]
    for broken in (whole[:-12], gzip.compress(b"hello\r\n\r\n"), gzip.compress(warc.record("response", "1", "u", b"abc"))):
        with pytest.raises(ValueError):
            list(warc.parse(broken))


def test_warc_of_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_monolithic(pages, f"{tmp_path}/crawl")
    warc.normalise(spark, f"{tmp_path}/crawl", f"{tmp_path}/normal")
    assert warc.read(spark, f"{tmp_path}/normal/archive").count() == 0


def toxic_corpus(spark, n=900):
    r, bad = random.Random(8), ["grumbl", "snarkle", "vexo"]
    rows, labels = [], []
    for i in range(n):
        w, toxic = words(i, r.randrange(5, 150), 3000), i % 4 == 0
        if toxic:
            for _ in range(r.randrange(1, 4)):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic), int(toxic)))
    return rows, labels


def test_toxicity_held_out_accuracy(spark):
    rows, labels = toxic_corpus(spark)
    docs, _ = documents(spark, [t for _, t in rows], nulls=False, clashing=True)
    ids = {i * 3 % 1009: i for i, _ in rows}
    table = spark.createDataFrame([(i * 3 % 1009, t) for i, t, _ in labels] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, table.where(~toxicity.held_out(F.col("doc_id"))))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [d for d in ids if zlib.crc32(str(d).encode()) % 4 == 2]
    right = [(got[d] >= 0.3) == bool(labels[ids[d]][1]) for d in held]
    assert len(held) > 150 and sum(right) / len(right) > 0.97
    kept = toxicity.keep_below(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, s in got.items() if s < 0.3}
    odd, _ = documents(spark, [None, "", "x" * 9999, "grumbl"])
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    docs, _ = documents(spark, ["a b", None], nulls=False)
    for labels in ([], [(0, 1)], [(0, None)]):
        table = spark.createDataFrame(labels, "doc_id long, toxic int")
        want = 1.0 if labels == [(0, 1)] else 0.0
        assert [round(r.score, 6) for r in toxicity.score(docs, toxicity.train(docs, table)).collect()] == [want, want]


def test_toxicity_takes_rows_of_each_class_by_itself(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(300)], "doc_id long, toxic int")
    taken = toxicity.training_rows(docs, labels, 40, "doc_id", "text", "toxic").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in taken} == {0: 40, 1: 30}
    # texts that tell nothing get the share of toxic rows among all labelled ones, not among the taken
    got = toxicity.score(docs, toxicity.train(docs, labels, max_rows=40)).first().score
    assert abs(got - 0.1) < 0.01


def test_toxicity_filter_sends_each_text_once(spark, monkeypatch):
    model = toxicity.Model((np.array([]), np.array([])), (np.array([]), np.array([])), (np.array([]), np.array([])), 1.0, (-2.0, 2.0, 0.0))
    rows = [(t, i, t) for i, t in enumerate(["a b", None, "", "c", "a b"])]
    docs = spark.createDataFrame(rows, "`a.text` string, doc_id long, Text string").repartition(1)
    sent, plain = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, *a, **b: sent.append(self.dtypes) or plain(self, *a, **b))
    kept = toxicity.keep_below(docs, model)
    assert sent == [[("row", "struct<a.text:string,doc_id:bigint,Text:string>")]]
    assert kept.dtypes == docs.dtypes and sorted(map(tuple, kept.collect()), key=lambda r: r[1]) == [rows[1], rows[2]]
    monkeypatch.setattr(toxicity, "batches", lambda stream: (b.slice(at, 2) for b in stream for at in range(0, b.num_rows, 2)))
    assert sorted(r.doc_id for r in toxicity.keep_below(docs, model).collect()) == [1, 2]


def test_toxicity_stores_bounded_tables_in_few_files(spark, monkeypatch):
    """However many tasks read the documents; what grows with them has files in proportion."""
    rows, labels = toxic_corpus(spark, 400)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(60)
    table = spark.createDataFrame([(i, t) for i, t, _ in labels], "doc_id long, toxic int")
    files, plain = {}, toxicity.stored

    def kept(df, *more):
        out = plain(df, *more)
        files.setdefault(tuple(out.columns), []).append(len(out.inputFiles()))
        return out
    monkeypatch.setattr(toxicity, "stored", kept)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        toxicity.train(docs, table, least_z=1.0, least_ratio=1.1)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert files.pop(("label", "doc_id", "text", "part"))[0] <= toxicity.TRAINING_FILES
    small = {k: v for k, v in files.items() if k not in (("label", "left", "word", "pair", "seen"), ("word", "n"))}
    assert len(small) == 4 and all(n == [1] for n in small.values())


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage against brute force on what its predecessor kept."""
    rows, labels = toxic_corpus(spark, 500)
    found = [t for _, t in rows] + texts(12, 30)
    df, _ = documents(spark, found, nulls=False)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i * 3 % 1009, 1, t) for i, t, _ in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, " ".join(found[41].split()[:12])), (2, "unheard of")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = df, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {d for d, _ in before}
            break
        assert out.dtypes == df.dtypes
        kept = {r.doc_id for r in out.collect()}
        if name == "toxicity":
            bad = {d for d, t in before if t and any(w in t.lower().split() for w in ("grumbl", "snarkle", "vexo"))}
            assert len({d for d, _ in before} - kept ^ bad) <= 0.02 * len(before)
        elif name == "exact_dedup":
            last = {}
            for d, t in before:
                last[(t or "").lower()] = max(d, last.get((t or "").lower(), -1))
            assert kept == set(last.values())
        elif name == "simhash_dedup":
            groups = slow_groups([slow_fingerprint(t) for _, t in before], 3)
            assert kept == {min(d for (d, _), g in zip(before, groups) if g == h) for h in set(groups)}
        else:
            assert kept == {r[0] for r in slow_contamination(before, items) if not r[-1]}
        docs = out
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == out.count()


def test_pipeline_bears_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and repeated rows, and columns of other
    names, one with a dot, go through all filter stages."""
    rows, labels = toxic_corpus(spark, 300)
    found = [t for _, t in rows] + [None, "", "\n"] + texts(13, 12)
    found[len(found) // 2] = "a quiet text"  # also that of the row without a doc_id
    df, _ = documents(spark, found, clashing=True)
    df = df.withColumn("row.key", F.lit("x")).withColumn("text_2", F.col("text"))
    spark.createDataFrame([(i * 3 % 1009, None, t) for i, t, _ in labels] + [(None, 1, 1), (7, None, None)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, ""), (2, " ".join(found[5].split()[:11]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = df
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == df.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        held = docs.collect()
        assert held and all(r["row.key"] == "x" and r.text_2 == r.text for r in held)
        if k == 0:  # a null text is no toxic one, and a null doc_id no reason to go
            assert any(r.text is None for r in held) and any(r.doc_id is None for r in held)
    assert sum(r.text is None or not r.text.strip() for r in held) >= 1
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()} == {r.doc_id for r in held}
    docs = df.limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0


def slow_ratio(training, corpus, least_z, least_ratio, span):
    """The two models written out over words: a function text -> (log ratio
    per word, that of the most toxic ``span`` words)."""
    triples = set()
    for label, text in training:
        w = [None, None, *alnum(text)]
        triples |= {(label, *w[i:i + 3]) for i in range(len(w) - 2)}
    seen = collections.Counter((label, left, word) for label, _, left, word in triples)

    def table(counts):
        """n-gram -> (toxic, ordinary) discounted, of those that differ clearly; totals of the classes"""
        keys = {k for _, k in counts}
        total = [max(1, sum(n for (label, _), n in counts.items() if label == c)) for c in (1, 0)]
        cut = []
        for c in (1, 0):
            own = [n for (label, _), n in counts.items() if label == c]
            cut.append(own.count(1) / (own.count(1) + 2 * own.count(2)) if own.count(1) else 0.5)
        out = {}
        for k in keys:
            t, p = counts[1, k], counts[0, k]
            share = (t + p) / sum(total)
            z = (t / total[0] - p / total[1]) / math.sqrt(share * (1 - share) * (1 / total[0] + 1 / total[1]) + 1e-300)
            apart = math.log((t + 0.5) / total[0] / ((p + 0.5) / total[1]))
            if abs(z) >= least_z and abs(apart) >= math.log(least_ratio):
                out[k] = max(t - cut[0], 0.0), max(p - cut[1], 0.0)
        return out, total

    words, total = table(collections.Counter((label, word) for label, _, word in seen))
    pairs, _ = table(collections.Counter({(label, (left, word)): n for (label, left, word), n in seen.items()}))
    held = collections.Counter(w for t in corpus for w in set(alnum(t)))
    rest = [max(1 - sum(c[i] for c in words.values()) / total[i], 1e-6) for i in (0, 1)]

    def of_word(w, i):
        return words.get(w, (0, 0))[i] / total[i] + rest[i] * (held.get(w, 0.5) / sum(held.values()))

    lefts = {}
    for left in {left for left, _ in pairs}:
        size = [max(1, sum(n for (label, x, _), n in seen.items() if (label, x) == (c, left))) for c in (1, 0)]
        lefts[left] = size, [max(1 - sum(c[i] for (x, _), c in pairs.items() if x == left) / size[i], 1e-3) for i in (0, 1)]

    def value(left, word):
        if (left, word) in pairs:
            size, own = lefts[left]
            t, p = (pairs[left, word][i] / size[i] + own[i] * of_word(word, i) for i in (0, 1))
            return math.log(t / p)
        back = math.log(of_word(word, 0) / of_word(word, 1)) if word in words else math.log(rest[0] / rest[1])
        return back + (math.log(lefts[left][1][0] / lefts[left][1][1]) if left in lefts else 0.0)

    def ratio(text):
        w = alnum(text)
        v = [value(a, b) for a, b in zip([None, *w], w)]
        n = min(span, len(v))
        return (sum(v) / len(v), max(sum(v[i:i + n]) / n for i in range(len(v) - n + 1))) if v else (0.0, 0.0)
    return ratio, len(words), len(pairs)


@pytest.mark.parametrize("least_z, least_ratio", [(toxicity.LEAST_Z, toxicity.LEAST_RATIO), (1.5, 1.2)])
def test_toxicity_scores_against_two_plain_models(spark, least_z, least_ratio):
    r = random.Random(23)
    rows = []
    for i in range(260):
        w = words(i, r.randrange(3, 60), 60)
        if i % 3 == 0:
            for _ in range(2):
                at = r.randrange(len(w))
                w[at:at] = r.choice([["you", "grumbl"], ["snarkle"], ["such", "a", "vexo"]])
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 220], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, least_z=least_z, least_ratio=least_ratio)
    part = {x.doc_id: x.part for x in toxicity.training_rows(docs, labels, 10_000, "doc_id", "text", "toxic").collect()}
    training = [(y, t) for i, t, y in rows if part.get(i, 3) != 3]
    ratio, n_words, n_pairs = slow_ratio(training, [t for _, t, _ in rows], least_z, least_ratio, toxicity.SPAN)
    assert n_words >= 2 and (least_z > 2 or n_pairs > 10)
    a, b, c = model.curve
    got = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    for i, t, _ in [*rows, (900, "", 0), (901, "", 0)]:
        mean, peak = ratio(t)
        assert got[i].ratio == pytest.approx(mean, abs=1e-9)
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-(a + b * mean + c * peak))), abs=1e-9)
    with pytest.raises(ValueError):
        toxicity.train(docs, labels, least_z=1.5, least_ratio=1.2, max_ngrams=1)
