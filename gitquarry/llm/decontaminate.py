"""Benchmark decontamination by a prefix-filtered set join.

A window is a run of ``window`` consecutive words of a benchmark item (all its
words if it has fewer).  A window is a set of word shingles, and a document
that contains the window contains all of them.  So one shingle is a sufficient
prefix: the rarest, counted over all documents (ties by hash).  Documents are
joined with windows on that shingle only.  Its offset in the window fixes
where the window would start; the length and position bounds drop starts
before the first and beyond the last word; the words from there on are then
compared with the window's words.

Scale: documents are read twice, once to count the benchmark's shingles and
once to find the prefix shingles.  In both, a filter of ``2**filter_bits``
bits (fixed size, built from the benchmark) drops nearly all other shingles
in the map task; the exact equi-joins follow.  A benchmark too large for the
filter costs more shuffled rows, never a wrong result.  Hits are joined with
the prefixes by an equi-join whose hot keys adaptive execution splits, and a
document's own hits are the largest group.

Defined cases: null and empty texts have no words, are never contaminated,
and an item without words has no window.  Rows repeating doc_id and text are
one result row; rows sharing a doc_id with other texts are judged each.  Hits
of items with a null item_id count as hits but are in no list.  Further
columns are ignored.  Empty tables give no rows, or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gitquarry.llm.common import alnum_words, batches, keep_rows, run_hashes, signed, stored, text_keys, texts, word_hashes

WINDOW = 10
SHINGLE = 3
FILTER_BITS = 22


def _windows(window: int, shingle: int):
    def windows(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            rows = []
            for item_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                words = alnum_words(text)
                width = min(window, len(words))
                size = min(shingle, width)
                hashes = signed(run_hashes(word_hashes(words), size)).tolist() if width else []
                for at in range(len(words) - width + 1 if width else 0):
                    rows.append({"item_id": item_id, "words": b" ".join(words[at:at + width]).decode(), "width": width, "size": size,
                                 "shingles": [{"off": i, "hash": hashes[at + i]} for i in range(width - size + 1)]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([
                ("item_id", batch.column(0).type), ("words", pa.string()), ("width", pa.int32()), ("size", pa.int32()),
                ("shingles", pa.list_(pa.struct([("off", pa.int32()), ("hash", pa.int64())])))]))
    return windows


def _bits(hashes: DataFrame, bits: int) -> bytes:
    """A bit table in which two bits stand for each hash; at most 2**bits
    bits reach the driver."""
    low = F.col("hash").bitwiseAND((1 << bits) - 1)
    high = F.shiftrightunsigned("hash", 64 - bits)
    places = hashes.select(F.explode(F.array(low, high)).alias("place"))
    words = (places.groupBy(F.shiftright("place", 5).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, CAST(place & 31 AS INT))")).alias("value")).collect())
    out = np.zeros(1 << (bits - 5), np.uint32)
    for word, value in words:
        out[word] = value
    return out.tobytes()


def _in_bits(bits: int, filled: bytes, hashes: np.ndarray) -> np.ndarray:
    held = np.frombuffer(filled, np.uint32)
    found = np.ones(len(hashes), bool)
    for place in (hashes & np.uint64((1 << bits) - 1), hashes >> np.uint64(64 - bits)):
        found &= (held[(place >> np.uint64(5)).astype(np.int64)] >> (place & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
    return found


def _counts(sizes: list[int], bits: int, filled: bytes):
    def counts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            found = []
            for text in texts(batch.column(0)):
                hashes = word_hashes(alnum_words(text))
                for size in sizes:
                    runs = run_hashes(hashes, size)
                    found.append(runs[_in_bits(bits, filled, runs)])
            values, n = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(values)), pa.array(n, pa.int64())], names=["hash", "n"])
    return counts


def _hits(sizes: list[int], window: int, bits: int, filled: bytes):
    def hits(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            found = texts(batch.column(1))
            n_words, rows = [], []
            for text in found:
                words = alnum_words(text)
                hashes, own = word_hashes(words), []
                for size in sizes:
                    runs = run_hashes(hashes, size)
                    for at in np.flatnonzero(_in_bits(bits, filled, runs)).tolist():
                        first = max(0, at - (window - size))
                        own.append({"hash": int(runs[at].view(np.int64)), "at": at, "first": first,
                                    "words": b" ".join(words[first:at + window]).decode()})
                n_words.append(len(words))
                rows.append(own)
            kind = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("words", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(text_keys(found)), pa.array(n_words, pa.int64()), pa.array(rows, kind)],
                names=["doc_id", "text_key", "n_words", "hits"])
    return hits


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  shingle: int = SHINGLE, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_hit, n_items,
    item_ids (sorted as strings) and contaminated."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    item_type = items.schema["item_id"].dataType.simpleString()
    id_type = source.schema["doc_id"].dataType.simpleString()
    shingle = min(shingle, window)
    windows = stored(items.mapInArrow(
        _windows(window, shingle),
        f"item_id {item_type}, words string, width int, size int, shingles array<struct<off:int,hash:long>>"))
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most ``shingle`` numbers
    tokens = windows.select("*", F.explode("shingles").alias("s")).select(
        "item_id", "words", "width", "s.off", "s.hash")
    held = tokens.select("hash").distinct()
    counts = (source.select("text").mapInArrow(_counts(sizes, filter_bits, _bits(held, filter_bits)), "hash long, n long")
              .groupBy("hash").agg(F.sum("n").alias("n")))
    rarity = stored(held.join(counts, "hash", "left").select("hash", F.coalesce("n", F.lit(0)).alias("n")))
    prefixes = stored(tokens.join(rarity, "hash").groupBy("item_id", "words", "width")
                      .agg(F.min(F.struct("n", "hash", "off")).alias("prefix"))
                      .where("prefix.n > 0").select("item_id", "words", "width", "prefix.hash", "prefix.off"))
    filled = _bits(prefixes.select("hash").distinct(), filter_bits)
    found = stored(source.mapInArrow(
        _hits(sizes, window, filter_bits, filled),
        f"doc_id {id_type}, text_key long, n_words long, hits array<struct<hash:long,at:int,first:int,words:string>>"))
    hits = found.where(F.size("hits") > 0).select("doc_id", "text_key", "n_words", F.explode("hits").alias("h")).select(
        "doc_id", "text_key", "n_words", "h.hash", "h.at", "h.first", F.col("h.words").alias("around"))
    start = F.col("at") - F.col("off")
    fits = (start >= F.col("first")) & (start + F.col("width") <= F.col("n_words"))
    there = F.array_join(F.slice(F.split("around", " "), start - F.col("first") + 1, F.col("width")), " ")
    matches = (hits.join(prefixes, "hash").where(fits)
               .where(there == F.col("words"))
               .select("doc_id", "text_key", "item_id", start.alias("start"), (start + F.col("width")).alias("end")))
    spans = matches.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    covered = F.expr("""aggregate(spans, named_struct('n', 0L, 'to', 0L), (a, s) -> named_struct(
        'n', a.n + greatest(0L, s.end - greatest(a.to, CAST(s.start AS LONG))),
        'to', greatest(a.to, CAST(s.end AS LONG))), a -> a.n)""")
    hit = spans.select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), covered.alias("n_hit"), "item_ids")
    rows = found.select("doc_id", "text_key", "n_words").distinct()
    same = rows["doc_id"].eqNullSafe(hit["hit_id"]) & (rows["text_key"] == hit["hit_key"])
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    item_ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return rows.join(hit, same, "left").select(
        "doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.size(item_ids).cast("long").alias("n_items"),
        item_ids.alias("item_ids"), (n_hit > 0).alias("contaminated"))


def clean_rows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of an item."""
    return keep_rows(docs, contamination(docs, benchmark, id_col, text_col).where("NOT contaminated"), id_col, text_col)
