"""SimHash near-duplicate groups, compared in bit slices.

Fingerprint: over the word shingles of the lower-cased text, bit i is 1 if it
is set in more than half of the shingles' XXH64 hashes.  Documents whose
fingerprints differ in at most ``radius`` bits are linked, and the connected
groups of links are the result.

Search: the 64 bits are split into ``blocks`` ranges.  Two fingerprints within
the radius agree in at least ``blocks - radius`` of them, so they meet under
one of the keys made of that many ranges.  Under a key, fingerprints are compared in bit slices: lanes of 64 comparisons
per machine word, one word per bit plane.  Planes are added into carry-save
counters, and lanes in which every comparison has exceeded the radius are
abandoned after each group of planes.

Scale: equal fingerprints are merged first, so exact copies cost nothing.  A
key that holds more than ``tile`` fingerprints is dealt into cells of about
that size; each pair of cells is a task-sized tile of its own, whatever the
key's share of the rows, so no pair is lost and no group is collected.  A
tile returns links of a spanning forest, not all pairs.  Groups are found by
repeated large-star and small-star steps over stored tables, with nothing but a
count on the driver.

Defined cases: a null or empty text has fingerprint zero and is linked like
any other.  Null doc_ids are ignored when the smallest doc_id is taken (null
if there is no other).  Rows repeating a doc_id are returned each.  Further
columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gitquarry.llm.common import batches, keep_rows, stored, text_keys, texts

SHINGLE = 3
RADIUS = 3
BLOCKS = 5
TILE = 2048
_SEED = 42
_PLANES_AT_ONCE = 8
_PAIRS_AT_ONCE = 1 << 18
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[shingle - 1:].tolist() or [len(line)]
    total, n = np.zeros(64, np.int64), len(last)
    for at in range(0, n, 1 << 15):
        parts = [line[i:j] for i, j in zip(starts[at:at + (1 << 15)].tolist(), last[at:at + (1 << 15)], strict=False)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(p, _SEED) for p in parts), np.uint64, len(parts))
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def fingerprints(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            found = texts(batch.column(1))
            values = np.array([fingerprint(t, shingle) for t in found], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(text_keys(found)), pa.array(values.view(np.int64))],
                names=["doc_id", "text_key", "fp"])
    return fingerprints


def key_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """The bits of each key: every choice of ``blocks - radius`` ranges."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    ranges = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(chosen) for chosen in combinations(ranges, blocks - radius)]


def within(plane, lanes: int, radius: int) -> np.ndarray:
    """For each lane a word whose bits tell which of its 64 comparisons are
    within the radius.  ``plane(bit, alive)`` gives the words of differing
    bits of the lanes in ``alive``."""
    slices = radius.bit_length()
    over = np.zeros(lanes, np.uint64)
    alive = np.arange(lanes)
    spare = (1 << slices) - 1 - radius  # the counters start here, so that exceeding the radius overflows them
    counters = [np.full(lanes, _ALL if spare >> i & 1 else 0, np.uint64) for i in range(slices)]
    gone = np.zeros(lanes, np.uint64)
    for first in range(0, 64, _PLANES_AT_ONCE):
        for bit in range(first, first + _PLANES_AT_ONCE):
            carry = plane(bit, alive)
            for counter in counters:
                counter ^= carry
                carry = carry & ~counter
            gone |= carry
        live = gone != _ALL
        if not live.all():
            over[alive[~live]] = _ALL
            alive, gone = alive[live], gone[live]
            counters = [c[live] for c in counters]
            if not len(alive):
                break
    over[alive] = gone
    return ~over


def _planes(values: np.ndarray) -> np.ndarray:
    """Bit planes, 64 rows of words; the last word is filled up with zeros."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[:len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _set_bits(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs left[i], right[j] within the radius; both
    sides at most a tile long."""
    planes, words = _planes(right), -(-len(right) // 64)
    found_i, found_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    step = max(1, _PAIRS_AT_ONCE // words)
    for at in range(0, len(left), step):
        some = left[at:at + step]

        def plane(bit: int, alive: np.ndarray) -> np.ndarray:
            query = (some[alive // words] >> np.uint64(bit)) & np.uint64(1)
            return planes[bit][alive % words] ^ (np.uint64(0) - query)

        places = _set_bits(within(plane, len(some) * words, radius))
        i, j = places // (64 * words), places % (64 * words)
        real = j < len(right)
        found_i.append(i[real] + at)
        found_j.append(j[real])
    return np.concatenate(found_i), np.concatenate(found_j)


def close_lists(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Places of the pairs left[i], right[i] within the radius."""
    planes = _planes(left ^ right)
    found = _set_bits(within(lambda bit, alive: planes[bit][alive], planes.shape[1], radius))
    return found[found < len(left)]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place that is linked to a smaller one, and the smallest place of its group."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            break
    members = np.flatnonzero(label != np.arange(n))
    return members, label[members]


def _links_of(tile: tuple[np.ndarray, np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """tile: fingerprints, and whether each is of the second cell (all false: one cell)."""
    values, second = tile
    if second.any():
        left, right = np.flatnonzero(~second), np.flatnonzero(second)
        if not len(left):
            return values[:0], values[:0]
        i, j = close_pairs(values[left], values[right], radius)
        i, j = left[i], right[j]
    else:
        i, j = close_pairs(values, values, radius)
        i, j = i[i < j], j[i < j]
    members, least = _forest(len(values), i, j)
    return values[members], values[least]


_SMALL = 48


def _small_runs(values: np.ndarray, second: np.ndarray, run: np.ndarray, crossed: np.ndarray, radius: int):
    """Links of many short runs at once."""
    found = []
    for distance in range(1, _SMALL):
        same = run[distance:] == run[:-distance]
        if not same.any():
            break
        left, right = np.flatnonzero(same), np.flatnonzero(same) + distance
        use = ~crossed[left] | (second[left] != second[right])
        left, right = left[use], right[use]
        near = close_lists(values[left], values[right], radius)
        found.append((values[right[near]], values[left[near]]))
    return found


def _links(radius: int):
    """Rows arrive sorted by tile: key_no, key, a, b, second, fp."""
    def table(found):
        if not found:
            return None
        u, v = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    def links(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[np.ndarray, ...] | None = None
        for batch in stream:
            columns = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            if kept is not None:
                columns = tuple(np.concatenate([x, y]) for x, y in zip(kept, columns, strict=True))
            n = len(columns[0])
            if not n:
                continue
            new = np.zeros(n, bool)
            new[0] = True
            for c in columns[:4]:
                new[1:] |= c[1:] != c[:-1]
            last = int(np.flatnonzero(new)[-1])
            kept = tuple(c[last:] for c in columns)  # the last tile may go on
            if last and (out := table(list(_of_tiles(tuple(c[:last] for c in columns), new[:last], radius)))):
                yield out
        if kept is not None and (out := table(list(_of_tiles(kept, np.arange(len(kept[0])) == 0, radius)))):
            yield out
    return links


def _of_tiles(columns: tuple[np.ndarray, ...], new: np.ndarray, radius: int):
    values, second = columns[5].view(np.uint64), columns[4].astype(bool)
    starts = np.append(np.flatnonzero(new), len(new))
    sizes = np.diff(starts)
    crossed = columns[2] != columns[3]
    small = np.repeat((sizes > 1) & (sizes <= _SMALL), sizes)
    if small.any():
        yield from _small_runs(values[small], second[small], np.repeat(np.arange(len(sizes)), sizes)[small], crossed[small], radius)
    for k in np.flatnonzero(sizes > _SMALL).tolist():
        part = slice(int(starts[k]), int(starts[k + 1]))
        if crossed[starts[k]] and not second[part].any():
            continue
        yield _links_of((values[part], second[part]), radius)


def links(fingerprints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) that leave every
    two fingerprints within the radius connected."""
    keys = F.array(*[F.struct(F.lit(i).alias("key_no"), F.col("fp").bitwiseAND(m - (1 << 64) if m >> 63 else m).alias("key"))
                     for i, m in enumerate(key_masks(blocks, radius))])
    keyed = fingerprints.select("fp", F.explode(keys).alias("k")).select("fp", "k.key_no", "k.key")
    sizes = keyed.groupBy("key_no", "key").count().where("count > 1")
    cells = F.ceil(F.col("count") / tile).cast("int")
    member = (keyed.join(sizes, ["key_no", "key"]).withColumn("cells", cells)
              .withColumn("cell", F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int")))
    dealt = member.select("fp", "key_no", "key", "cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other"))
    tiles = dealt.select("key_no", "key", F.least("cell", "other").alias("a"), F.greatest("cell", "other").alias("b"),
                         (F.col("cell") > F.col("other")).alias("second"), "fp")
    place = ["key_no", "key", "a", "b"]
    parts = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (tiles.repartition(parts, *place).sortWithinPartitions(*place, "second", "fp")
            .mapInArrow(_links(radius), "u long, v long"))


def groups(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v) that is not
    the smallest of its connected group; root is that smallest node."""
    current = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        linked = (joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                  .unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        current = stored(linked)
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, fp (signed), fingerprint
    (hex), component_id (the group's smallest doc_id)."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    rows = stored(source.mapInArrow(_fingerprints(shingle), f"doc_id {id_type}, text_key long, fp long"))
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = groups(links(distinct.select("fp"), radius, blocks, tile))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = rooted.join(ids, "root").select("fp", "component_id")
    return rows.join(labels, "fp").select(
        "doc_id", "text_key", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose doc_id is their group's component_id; of a
    group without doc_ids all rows stay."""
    found = near_duplicates(docs, id_col, text_col, shingle, radius)
    return keep_rows(docs, found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))), id_col, text_col)
