"""The operators' queries over the tables of a folder, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gitquarry.llm import (bpe, decontaminate, exact_dedup, lexical, licenses, packing, periodic, pii, simhash, substring_dedup, toxicity,
                           url_filter, warc)
from gitquarry.llm.common import fresh_folder, table


VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark)
    warc.write_monolithic(table(spark, sf_dir, "pages"), f"{folder}/crawl")
    warc.normalise(spark, f"{folder}/crawl", f"{folder}/normal")
    return warc.read(spark, f"{folder}/normal/archive", with_payload=False, names="part-*").select(
        warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        warc.page_of("refers_to").alias("refers_to"))


def op4_seed_and_extend_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_block_naming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_association_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), toxicity.held_out(F.col("doc_id"))
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    joined = lambda name: F.array_join(F.transform(name, pii.span_text), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op9_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op10_diagonal_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score")


def op11_monoid_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)
    return bpe.decode(encoded, BYTE_RANKS, public_tokenizers.PATTERN).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and the contract's text: in documents whose h = crc32(doc_id) divides
    by 10, the words from a on repeat with period p.  A null doc_id has no h."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size("w").cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    word = lambda i: F.get("w", F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
    rewritten = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), word), " ")
    planted = F.when(h % 10 == 0, words)
    return docs.select("doc_id", "text", planted.alias("w")).select(
        "doc_id", F.when(F.size("w") > 0, rewritten).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find(with_planted_periods(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"),
                                                              (-r["period"]).alias("finer"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    length, period = F.col("best.length"), -F.col("best.finer")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.before")).alias("start"), length.alias("length"),
        period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_shared_subexpression_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


QUERIES = {f.__name__: f for f in (
    op1_simhash_near_dedup, op2_harmonic_packing, op3_warc_normaliser, op4_seed_and_extend_dedup, op5_block_naming_dedup,
    op6_association_url_filter, op7_kneser_ney_toxicity, op8_weak_supervision_pii, op9_prefix_decontamination,
    op10_diagonal_license_scan, op11_monoid_tree_bpe, op12_periodic_runs, op13_shared_subexpression_search)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x{7F}]+"

ORACLE = {
    "op3_warc_normaliser": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
        g AS (SELECT page_id, strlen(x) AS payload_bytes, sha1(x) AS payload_digest, max(page_id) OVER (PARTITION BY x) AS last_id FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
        FROM g""",
    "op4_seed_and_extend_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s
                FROM d, unnest(generate_series(1, len(w) - 19)) AS u(i) WHERE len(w) >= 20),
        again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win)
                  WHERE k > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS j FROM again),
        lists AS (SELECT doc_id, list(j) AS js, count(*) AS n FROM gone GROUP BY doc_id),
        word AS (SELECT doc_id, i, w[i] AS x FROM d, unnest(generate_series(1, len(w))) AS u(i)),
        kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.i) AS s
                 FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.j = word.i
                 WHERE gone.j IS NULL GROUP BY word.doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
        FROM d LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op5_block_naming_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS x FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
        FROM t""",
    "op9_prefix_decontamination": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k,
                      array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
               FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS u(i) WHERE len(w) > 0),
        dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
               FROM d, (SELECT DISTINCT k FROM bw) AS ks, unnest(generate_series(1, len(w) - k + 1)) AS u(i)
               WHERE len(w) >= k),
        m AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw USING (k, s)),
        hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit
                FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS j FROM m) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
                FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op12_periodic_runs": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w0 FROM documents),
        c AS (SELECT *, CAST(len(w0) AS BIGINT) AS n, xor(list_reduce(
                  list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
                  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
                                        lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) AS h FROM d),
        g AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM c),
        p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM g),
        word AS (SELECT rid, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN w0[a + (i - a) % p + 1] ELSE w0[i + 1] END AS x
                 FROM p, unnest(generate_series(0, n - 1)) AS u(i) WHERE n > 0),
        same AS (SELECT l.rid, r.i - l.i AS q, l.i FROM word AS l JOIN word AS r ON l.rid = r.rid AND l.x = r.x AND r.i > l.i
                 WHERE 4 * (r.i - l.i) <= l.n),
        part AS (SELECT rid, q, min(i) AS s, count(*) + q AS len
                 FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS k FROM same) GROUP BY rid, q, k),
        long AS (SELECT * FROM part WHERE len >= greatest(6, 4 * q)),
        run AS (SELECT * FROM long AS r WHERE NOT EXISTS (
                  SELECT 1 FROM long AS f WHERE f.rid = r.rid AND f.q < r.q AND f.s <= r.s AND f.s + f.len >= r.s + r.len)),
        best AS (SELECT rid, count(*) AS n_runs, max_by(struct_pack(s, len, q), (len, -s, -q)) AS b,
                        string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM run GROUP BY rid),
        gone AS (SELECT DISTINCT rid, unnest(generate_series(s + q, s + len - 1)) AS i FROM run),
        kept AS (SELECT word.rid, string_agg(x, ' ' ORDER BY word.i) AS x
                 FROM word LEFT JOIN gone ON gone.rid = word.rid AND gone.i = word.i WHERE gone.i IS NULL GROUP BY word.rid)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.len AS length, b.q AS period, 1000 * b.len // b.q AS exponent_milli,
               sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(x, '')) AS collapsed_sha256
        FROM d LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)""",
    "op13_shared_subexpression_search": f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                          regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents),
        s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
        posting AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) GROUP BY rid, t),
        weight AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM posting, s GROUP BY t, n_docs),
        item AS (SELECT item_id, t, count(*) AS r
                 FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}')) AS t FROM benchmark)
                 GROUP BY item_id, t),
        norm AS (SELECT rid, doc_id, 75 + (25 * len(w) * n_docs) // n_terms AS m FROM d, s),
        scored AS (SELECT item_id, doc_id, CAST(sum(r * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
                   FROM item JOIN weight USING (t) JOIN posting USING (t) JOIN norm USING (rid) GROUP BY item_id, rid, doc_id)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
        WHERE rank <= 20""",
}
