"""Decontamination, licences, personal data and url rules against brute force."""

import collections
import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from gitquarry.llm import decontaminate, licenses, pii, url_filter
from gitquarry.llm.queries import QUERIES
from tests.llm.corpus import documents, texts, words

ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def alnum(t):
    return ALNUM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def slow_contamination(rows, items, window=10):
    wins = collections.defaultdict(set)
    for item, t in items:
        w = alnum(t)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            wins[tuple(w[i:i + k])].add(item)
    out = collections.Counter()
    for doc, t in {(r[0], r[1] or "") for r in rows}:
        w, hit, found = alnum(t), set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                if (m := wins.get(tuple(w[i:i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    found |= {str(x) for x in m if x is not None}
        out[doc, len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit)] += 1
    return out


@pytest.mark.parametrize("filter_bits", [22, 8])
def test_decontamination(spark, filter_bits):
    """With a filter of 256 bits nearly every shingle passes it, and the result is the same."""
    found = texts(7, 40)
    items = [(i, " ".join(alnum(t)[5:5 + 14 + i])) for i, t in enumerate(found[10:20])]
    items += [(100, "the"), (101, "W7, of"), (102, None), (103, "!?"), (None, " ".join(alnum(found[30])[:12])), (104, items[3][1]), (104, items[3][1])]
    df, rows = documents(spark, found, clashing=True)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("hash", F.lit(1)).withColumn("words", F.lit(2))
    got = decontaminate.contamination(df, bench, filter_bits=filter_bits).collect()
    have = collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r.item_ids), r.contaminated) for r in got)
    assert have == slow_contamination(rows, items)


def test_decontamination_of_empty_tables(spark):
    df, rows = documents(spark, ["a b", "c"], nulls=False)
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contamination(df.limit(0), bench).count() == 0
    assert [r.contaminated for r in decontaminate.contamination(df, bench.limit(0)).collect()] == [False, False]
    clean = decontaminate.clean_rows(df, bench)
    assert clean.columns == df.columns and [r.doc_id for r in clean.collect()] == [3]


def test_license_scan(spark):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    lines = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "CC BY-NC cc by nc BY NC", "under the mit under the mit license",
             "This work is licensed under the GNU General Public License, version 3.", "the terms of"]
    r = random.Random(3)
    found = [None, "", *lines, "x" * 20_000] + [" ".join(words(i, 30) + r.sample(lines, 2) + words(i + 50, 20) + r.sample(lines, 1)) for i in range(30)]
    df, rows = documents(spark, found, clashing=True)
    got = licenses.scan(df).collect()
    want = collections.Counter()
    for doc, t, *_ in rows:
        w = alnum(t)
        places = sorted((i, label) for p, label in phrases.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
        labels = ",".join(sorted({x for _, x in places}))
        want[doc, len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, labels] += 1
    assert collections.Counter((x.doc_id, x.n_words, x.n_base, x.first_word, x.last_word, ",".join(x.base_labels)) for x in got) == want
    assert all(0 <= x.score <= 1 and set(x.base_labels) <= set(x.labels) and x.labels == sorted(x.labels) for x in got)
    whole = {d: t for d, t, *_ in rows}
    assert all(("gpl-3" in x.labels) == ("general public license version 3" in " ".join(alnum(whole[x.doc_id]))) for x in got)
    assert licenses.scan(df.limit(0)).count() == 0


def test_license_notice_with_changed_words(spark):
    """A word more, less or changed still leaves the notice on neighbouring diagonals."""
    notice = [n for n, label in licenses.NOTICES.items() if label == "bsd"][0].split()
    changed = [*notice[:6], "extra", *notice[6:12], *notice[13:]]
    df, _ = documents(spark, [" ".join(words(1, 40) + changed + words(2, 40)), " ".join(notice[:6] + words(3, 60))], nulls=False)
    by_id = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert by_id[0].labels == ["bsd"] and 0.8 <= by_id[0].score < 1 and by_id[0].notices[0].start in range(36, 45)
    assert by_id[3].labels == [] and by_id[3].score < 0.8


def luhn(d):
    s = [int(c) for c in d[::-1]]
    return (sum(s[::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0


def slow_spans(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 1, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 2, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 3, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 4, "phone", m.end()))
    return sorted(out)


def private_texts():
    r = random.Random(11)
    parts = ["a@b.com", "a.b+c@d-e.co.uk_x@y.org", "@x.com", "a@b", "é\U0001F600", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "007.08.9.10", "1.2.3", "4111 1111 1111 1111",
             "4111-1111-1111-1112", "4111111111111111", "5500 0000 0000 0004x", "0000000000000", "+1 (803) 555-5351", "+49 30 1234567.", "+1", "+(5)", "12 34", "x%y@z.q.",
             "call 803-555-5351", "joe [at] mail [dot] com", "v1.2.3.4", "\n", "--", "+33-1.22.33.44.55 66 77 88 99", "99999999999999999999"]
    out = [None, "", "a" * 30_000, "a" * 30_000 + "@b.com", "1" * 30_000, "." * 9_000 + "@", "+1" + "(" * 20_000, "a.b@" + "c." * 9_000 + "d", "1 " * 20_000]
    return out + ["".join(r.choice([*parts, " ", " ", "w "]) for _ in range(r.randrange(30))) for _ in range(300)]


def test_base_spans(spark):
    df, rows = documents(spark, private_texts(), clashing=True)
    got = pii.find(df).collect()
    want = collections.Counter((r[0], tuple(slow_spans(r[1]))) for r in rows)
    have = collections.Counter((r.doc_id, tuple((s.start, s.kind_no, s.kind, s.end) for s in r.base)) for r in got)
    assert have == want
    for r in got:
        base, every = [tuple(s) for s in r.base], [tuple(s) for s in r.spans]
        assert set(base) <= set(every) and every == sorted(every)
    assert pii.find(df.limit(0)).count() == 0


def test_reliabilities_find_the_better_labelers():
    r = random.Random(5)
    rows = collections.Counter()
    for _ in range(4000):
        y = r.random() < 0.4
        rows["card", tuple((1 if y == (r.random() < p) else -1) if r.random() < q else 0 for p, q in ((0.95, 1), (0.85, 0.9), (0.55, 0.8), (0.8, 0.7)))] += 1
    model = pii.reliabilities([(k, list(v), n) for (k, v), n in rows.items()])
    accuracy = [sum(x) / 2 for x in model["right"]["card"]]
    assert accuracy[0] > accuracy[1] > accuracy[2] and abs(accuracy[0] - 0.95) < 0.06 and abs(model["share"]["card"] - 0.4) < 0.06


def test_added_spans(spark):
    """Obfuscated addresses and bare phone numbers are added; numbers that
    fail their kind's checks never are, however many valid ones are like them."""
    r = random.Random(17)
    found = [f"version 1.2.{i % 7}.{i} here" for i in range(300)] + [f"login from address 10{i % 9}.2.3.{i % 200} now" for i in range(100)]
    found += [f"write to joe{i} [at] mail{i % 9} [dot] com please" for i in range(150)] + [f"contact ann{i}@mail.com please" for i in range(150)]
    found += [f"phone 803-555-{1000 + i} today" for i in range(150)] + [f"call +1 803 555 {1000 + i} today" for i in range(150)]
    found += [f"card {r.randrange(10 ** 15, 10 ** 16)} used" for i in range(100)]
    df, _ = documents(spark, found, nulls=False)
    out = {r.text: r for r in pii.find(df, id_col="text").select("base", "spans", F.col("doc_id").alias("text")).collect()}
    added = {t: [t[s.start:s.end] for s in x.spans if s not in x.base] for t, x in out.items()}
    ok = {t: [t[s.start:s.end] for s in x.base] for t, x in out.items()}
    assert all(added[t] == [] for t in found if t.startswith(("version", "login", "contact", "call", "card")))
    assert all(ok[t] == [] for t in found if t.startswith("version") and int(t.split(".")[3].split()[0]) > 255)
    assert sum(added[t] == [" ".join(t.split()[2:-1])] for t in found if t.startswith("write")) >= 145
    assert sum(added[t] == [t.split()[1]] for t in found if t.startswith("phone")) >= 145


URLS = ["https://a.Example.NET/en/x.html?q=1#t", "http://example.net/de/", "http://net/x", "http://xnet/x", "https://b.org/fr/1", "https://b.org/fr", "HTTP://Example.com/de/9?A=b",
        "http://example.com/en/", "https://c.example.com", "https://example.net", "no scheme", "", None, "://", "http://a.net?x://y/z", "x://e.net/en/\nfr", "http://user@e.org:80/fr/",
        "http://İ.net/", "https://b.org/fr/1"]


def slow_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.sub("[A-Z]", lambda m: m.group().lower(), re.match("[^/?#]*", rest)[0])
    path = re.match("[^/?#]*([^?#]*)", rest)[1]
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name), default=None)


def test_fixed_url_rules(spark):
    pages = spark.createDataFrame([(i if i else None, u, "h", 1) for i, u in enumerate(URLS)], "page_id long, url string, host string, tokens int")
    got = collections.Counter((r.page_id, r.host, r.path, r.rule) for r in url_filter.judge(pages).collect())
    want = collections.Counter()
    for i, u in enumerate(URLS):
        host, path, rule = slow_rule(u)
        want[i if i else None, host, path, rule.name if rule else None] += 1
    assert got == want
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_mined_rules_against_brute_force(spark):
    r = random.Random(4)
    rows = []
    for i in range(400):
        tokens = sorted({f"t{r.randrange(8)}" for _ in range(r.randrange(1, 5))} | ({"bad"} if r.random() < 0.3 else set()))
        rows.append((tokens, "block" if ("bad" in tokens and r.random() < 0.95) or r.random() < 0.1 else "allow"))
    labelled = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    got = {(tuple(x.tokens), x.verdict): (round(x.confidence, 9), round(x.support, 9)) for x in url_filter.mine(labelled, 0.02, 0.8, 3, 1000).collect()}
    every = {}
    for k in (1, 2, 3):
        for body in itertools.combinations(sorted({t for ts, _ in rows for t in ts}), k):
            held = [v for ts, v in rows if set(body) <= set(ts)]
            for verdict in ("allow", "block"):
                n = held.count(verdict)
                if n / len(rows) >= 0.02 and n / len(held) >= 0.8:
                    every[body, verdict] = (n / len(held), n / len(rows))
    want = {k: (round(c, 9), round(s, 9)) for k, (c, s) in every.items()
            if not any(v == k[1] and set(b) < set(k[0]) and every[b, v][0] >= c for b, v in every)}
    assert got == want and any("bad" in body for body, v in got if v == "block")


def test_no_mined_rule_is_cut_by_number_or_length(spark):
    """1,400 rules of up to three tokens with confidence 1 that shorter ones cover, a less confident rule, and one of four tokens."""
    rows = [([f"g{g}t{i}" for i in range(10)], "block") for g in range(8)] * 10
    rows += [(["shop"], "allow")] * 9 + [(["shop"], "block")] + [(list("abcd"), "block")] * 10
    rows += [([x for x in "abcd" if x != y], "allow") for y in "abcd"] * 10
    labelled = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    got = {(tuple(x.tokens), x.verdict): x.confidence for x in url_filter.mine(labelled, 0.01, 0.8).collect()}
    assert got.pop((("shop",), "allow")) == 0.9 and got.pop((tuple("abcd"), "block")) == 1.0
    assert got == {((f"g{g}t{i}",), "block"): 1.0 for g in range(8) for i in range(10)}


def test_mined_rules_decide(spark):
    """Urls that no fixed rule fits get the verdict of the most confident mined rule whose tokens they hold."""
    r = random.Random(6)
    urls = [f"http://{r.choice(['a', 'spam', 'b'])}.example.{r.choice(['com', 'net', 'org'])}/{r.choice(['en', 'fr', 'de', 'es'])}/{r.randrange(99)}" for _ in range(500)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = url_filter.split_urls(pages, "page_id", "url").withColumn("tokens", url_filter.tokens()).withColumn("fixed", url_filter.fixed_rule(url_filter.RULES))
    tokens = {x.page_id: set(x.tokens) for x in rows.collect()}
    mined = url_filter.mine(rows.where("fixed IS NOT NULL").select("tokens", "fixed.verdict")).collect()
    assert mined
    for x in url_filter.judge(pages).collect():
        rule = slow_rule(urls[x.page_id])[2]
        fits = [m for m in mined if set(m.tokens) <= tokens[x.page_id]]
        best = max(fits, key=lambda m: (m.confidence, m.support, m.tokens, m.verdict), default=None)
        assert x.verdict == (rule.verdict if rule else best.verdict if best else "allow")


def test_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert hashlib.sha256(b"").hexdigest()[:8] == "e3b0c442"


def test_tokens_of_the_same_rows_are_mined_as_one(spark):
    """Forty query fields that always go together would give 2 ** 40 sets."""
    r = random.Random(19)
    fields = "&".join(f"f{c}{d}={r.randrange(9)}" for c in "abcdefgh" for d in "ABCDE")
    urls = [f"http://shop.net/en/{i}?{fields}" for i in range(60)] + [f"http://x{i}.org/fr/a" for i in range(200)]
    urls += [f"http://y{i}.info/shop?{fields}" for i in range(5)] + ["http://z.info/?fcC=1&other=2", "http://z.info/plain", None]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {x.page_id: x for x in url_filter.judge(pages).collect()}
    assert all(got[i].rule == "net/" for i in range(60)) and all(got[i].rule == "org/fr/" for i in range(60, 260))
    assert all(got[i].verdict == "block" and got[i].mined_tokens == ["field=fhe"] for i in range(260, 265))
    assert got[265].verdict == "block" and got[265].mined_tokens == ["field=fcc"]  # one token of the class is enough
    assert got[266].verdict == got[267].verdict == "allow" and got[266].mined_tokens is None


def test_equal_tokens(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b"]), (3, ["a", "b", "d"]), (4, [])], "row long, tokens array<string>")
    assert {(x.token, x.item) for x in url_filter.equal_tokens(rows, 0.2).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")}
    assert {x.token for x in url_filter.equal_tokens(rows, 0.3).collect()} == {"a", "b"}
