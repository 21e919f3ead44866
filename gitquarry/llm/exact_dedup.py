"""Exact de-duplication by deterministic block naming.

A text (lower-cased A-Z only, as UTF-8) is cut into blocks of a fixed number
of bytes.  Round 0 sorts the distinct blocks and gives each an integer name.
Every further round joins adjacent names of a document to pairs, sorts the
distinct pairs and names those, until each document has a single name.  Two
documents end with the same name in the same round exactly if their texts are
equal: a block is named by its bytes, not by a hash of them.

Bytes are shuffled once.  They are grouped by a 64-bit hash with the blocks
of a hash kept apart as a set; (hash, place in the sorted set) is then what
is sorted and joined.  Only where one hash has several blocks does the way
back compare bytes.

Scale: distinct blocks and pairs are partially aggregated before every
shuffle, so a block that a third of all rows hold arrives once per map task.
The joins that hand out names are plain equi-joins, whose hot keys adaptive
execution splits.  Rounds are logarithmic in the longest text, and a document
leaves when it has one name.

Defined cases: a null text counts as empty, and empty texts are equal.  A
null doc_id is kept as a row; it is ``keep_id`` only of a group in which all
are null.  Rows repeating doc_id and text count each in ``group_size`` and
share their fate.  Further columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gitquarry.llm.common import batches, keep_rows, stored, text_keys, texts

BLOCK_BYTES = 4096


def _documents(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(stream):
        found = texts(batch.column(1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(text_keys(found)),
             pa.array([hashlib.sha256(t.lower()).hexdigest() for t in found], pa.string())],
            names=["doc_id", "text_key", "text_sha256"])


def _cut(block_bytes: int, hash_bits: int, with_bytes: bool):
    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            ids, keys, seqs, counts, hashes, blocks = [], [], [], [], [], []
            found = texts(batch.column(1))
            for doc_id, key, text in zip(batch.column(0).to_pylist(), text_keys(found), found, strict=True):
                text = text.lower()
                parts = [text[i:i + block_bytes] for i in range(0, max(1, len(text)), block_bytes)]
                ids += [doc_id] * len(parts)
                keys += [key] * len(parts)
                seqs += range(len(parts))
                counts += [len(parts)] * len(parts)
                hashes += [(xxhash.xxh64_intdigest(p) >> (64 - hash_bits)) - (1 << hash_bits - 1) for p in parts]
                blocks += parts
            columns = [pa.array(ids, batch.column(0).type), pa.array(keys, pa.int64()), pa.array(seqs, pa.int64()),
                       pa.array(counts, pa.int64()), pa.array(hashes, pa.int64())]
            names = ["doc_id", "text_key", "seq", "n", "hash"]
            if with_bytes:
                columns.append(pa.array(blocks, pa.binary()))
                names.append("block")
            yield pa.RecordBatch.from_arrays(columns, names=names)
    return cut


def numbered(distinct: DataFrame, columns: list[str]) -> DataFrame:
    """Sort rows that are all different and number them in that order.  The
    number of ranges is left to adaptive execution, which merges small ones."""
    ordered = distinct.repartitionByRange(*columns).sortWithinPartitions(*columns)
    return stored(ordered.withColumn("name", F.monotonically_increasing_id()))


def _block_names(source: DataFrame, id_type: str, block_bytes: int, hash_bits: int) -> DataFrame:
    """(doc_id, text_key, seq, n, name) of every block."""
    plain = f"doc_id {id_type}, text_key long, seq long, n long, hash long"
    with_bytes = source.mapInArrow(_cut(block_bytes, hash_bits, True), plain + ", block binary")
    sets = with_bytes.groupBy("hash").agg(F.array_sort(F.collect_set("block")).alias("blocks"))
    several = F.size("blocks") > 1
    variants = sets.select("hash", F.posexplode("blocks").alias("variant", "block"), several.alias("clash"))
    names = numbered(variants.select("hash", "variant", "clash", F.when(F.col("clash"), F.col("block")).alias("block")),
                     ["hash", "variant"])
    single = names.where(~F.col("clash")).select("hash", "name")
    blocks = source.mapInArrow(_cut(block_bytes, hash_bits, False), plain)
    out = blocks.join(single, "hash").select("doc_id", "text_key", "seq", "n", "name")
    clashes = names.where("clash").select("hash", "block", "name")
    if not clashes.isEmpty():
        out = out.unionByName(with_bytes.join(clashes, ["hash", "block"])
                              .select("doc_id", "text_key", "seq", "n", "name"))
    return out


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """One row per (doc_id, text_key): ``round`` and ``name`` are equal for
    two documents exactly if their normalised texts are equal."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    named = stored(_block_names(source, id_type, block_bytes, hash_bits))
    longest = named.agg(F.max("n")).first()[0] or 0
    done = [named.where("n = 1").select("doc_id", "text_key", F.lit(0).alias("round"), "name").distinct()]
    current, rounds = named.where("n > 1"), 0
    while longest > 1:
        rounds, longest = rounds + 1, (longest + 1) // 2
        even = F.col("seq") % 2 == 0
        pairs = (current.groupBy("doc_id", "text_key", F.floor(F.col("seq") / 2).alias("seq"))
                 .agg(F.max(F.when(even, F.col("name"))).alias("left"),
                      F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right"),
                      F.max(F.floor((F.col("n") + 1) / 2)).alias("n")))
        pairs = stored(pairs)
        names = numbered(pairs.select("left", "right").distinct(), ["left", "right"])
        named = pairs.join(names, ["left", "right"]).select("doc_id", "text_key", "seq", "n", "name")
        named = stored(named) if longest > 1 else named
        done.append(named.where("n = 1").select("doc_id", "text_key", F.lit(rounds).alias("round"), "name"))
        current = named.where("n > 1")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, keep_id, group_size,
    kept and text_sha256.  Of equal texts the largest doc_id stays."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    rows = source.mapInArrow(_documents, f"doc_id {id_type}, text_key long, text_sha256 string")
    known = identities(docs, id_col, text_col, block_bytes, hash_bits)
    same = rows["doc_id"].eqNullSafe(known["doc_id"]) & (rows["text_key"] == known["text_key"])
    members = stored(rows.join(known, same).select(rows["doc_id"], rows["text_key"], "text_sha256", "round", "name"))
    # stored, so that both sides of the join are plain exchanges, whose hot keys adaptive execution splits
    groups = stored(members.groupBy("round", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    return (members.join(groups, ["round", "name"])
            .select("doc_id", "text_key", "keep_id", "group_size",
                    F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return keep_rows(docs, assign(docs, id_col, text_col).where("kept"), id_col, text_col)
