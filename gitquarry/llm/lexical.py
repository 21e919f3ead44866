"""Ranked lexical search of many items by common sub-expressions.

A document's score for an item is a sum over the item's terms.  Items that
share a set of terms share a part of that sum.  Shared sets are mined among
the items: terms stand in one order for all items, the most widely shared
first, and the neighbours that most items have in common become a node of a
graph, round by round, until no two neighbours are shared.  A node is the sum of two earlier ones, so the nodes form a
query-sharing graph without cycles (``Sharing``).  For a batch of documents the
accumulator of each node is computed once, in the order of its levels, and each item
adds up the few nodes that it is left with.

Fixed-point scores: N documents have a term, L terms are in them, n in one; a term in
df documents has the weight w = floor(1000 ln((2N+2) / (2df+1))); with
m = 75 + (25 n N) div L, a document scores the sum over the item's terms, repeats
included, of w ((10^9 tf) div (1000 tf + 12 m)).

Scale: items are taken in blocks of a checked size (``block_terms``; a single
longer item is a block of its own); each block is mined in a task of its own and then meets all documents in
one pass.  Per block the documents' postings (only terms of the block's items) are written once; document
frequencies are partially aggregated counts over them.  A task keeps the ``top`` best documents of each
item, so neither documents nor pairs of documents and items are shuffled; the best of the tasks are
narrowed in two steps, by item and salt and then by item.

Defined cases: a null or empty text has no terms and does not count in N; an
item without terms has no result.  Rows repeating doc_id and text are documents each;
rows repeating item_id and text are one item; several texts of one item_id are an item
each, with a ranking of its own.  A null item_id or doc_id is carried, null before other doc_ids of equal
score.  Further columns are ignored.  Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gitquarry.llm.common import alnum_words, batches, stored, text_key, texts

TOP = 20
#: Distinct (item, term) pairs that a block of items holds, and numbers that a task's accumulators hold.
BLOCK_TERMS, NUMBERS_AT_ONCE = 20_000, 1 << 20
_SALTS = 64
_NO_ID = -(1 << 63)


@dataclass
class Sharing:
    """``leaves`` are (term, repeats).  Node i of the others is the sum of
    nodes ``left[i]`` and ``right[i]``; nodes are counted from the leaves on.
    ``items`` lists the nodes whose sum is an item."""

    leaves: list[tuple[bytes, int]]
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    items: list[list[int]] = field(default_factory=list)


def mine(items: list[list[tuple[bytes, int]]]) -> Sharing:
    """The sharing graph of items, each a list of different (term, repeats).
    A round replaces neighbours from the most to the least shared, each node
    in one pair only; every pass is linear in the items' length."""
    shared = Counter(leaf for item in items for leaf in item)
    leaves = sorted(shared, key=lambda leaf: (-shared[leaf], leaf))
    number = {leaf: i for i, leaf in enumerate(leaves)}
    out = Sharing(leaves, items=[sorted(map(number.__getitem__, item)) for item in items])
    while True:
        pairs = Counter(pair for item in out.items for pair in zip(item, item[1:], strict=False))
        made: dict[tuple[int, int], int] = {}
        taken: set[int] = set()
        for times, pair in sorted(((-n, pair) for pair, n in pairs.items() if n > 1)):
            if not taken & set(pair):
                taken |= set(pair)
                made[pair] = len(leaves) + len(out.left)
                out.left.append(pair[0])
                out.right.append(pair[1])
        if not made:
            return out
        for k, item in enumerate(out.items):
            new, i = [], 0
            while i < len(item):
                node = made.get((item[i], item[i + 1])) if i + 1 < len(item) else None
                new.append(item[i] if node is None else node)
                i += 1 if node is None else 2
            out.items[k] = new


def _levels(graph: Sharing) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, left, right) of nodes that need only earlier levels."""
    level = [0] * len(graph.leaves)
    for a, b in zip(graph.left, graph.right, strict=True):
        level.append(max(level[a], level[b]) + 1)
    known = np.array(level[len(graph.leaves):], np.int64)
    left, right = np.array(graph.left, np.int64), np.array(graph.right, np.int64)
    nodes = [np.flatnonzero(known == i) for i in range(1, max(level, default=0) + 1)]
    return [(at + len(graph.leaves), left[at], right[at]) for at in nodes]


class Accumulators:
    """Scores of a batch of documents for all items of a graph."""

    def __init__(self, graph: Sharing, terms: list[bytes], weights: np.ndarray, n_docs: int, n_terms: int):
        place = {t: i for i, t in enumerate(terms)}
        self.terms, self.weights, self.n_docs, self.n_terms = len(terms), weights, n_docs, n_terms
        self.leaf_terms = np.array([place[t] for t, _ in graph.leaves], np.int64)
        self.repeats = np.array([r for _, r in graph.leaves], np.int64)[:, None]
        self.levels, self.nodes = _levels(graph), len(graph.leaves) + len(graph.left)
        self.parts = np.array([n for item in graph.items for n in item], np.int64)
        self.starts = np.cumsum([0, *map(len, graph.items)])[:-1]
        #: Documents of one batch.
        self.rows = max(16, NUMBERS_AT_ONCE // max(1, self.nodes + len(self.parts)))

    def scores(self, lengths: np.ndarray, docs: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Items by documents; ``docs``, ``terms`` and ``tf`` are the postings."""
        m = 75 + (25 * lengths * self.n_docs) // self.n_terms
        own = np.zeros((self.terms, len(lengths)), np.int64)
        own[terms, docs] = self.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[docs]))
        nodes = np.empty((self.nodes, len(lengths)), np.int64)
        nodes[:len(self.leaf_terms)] = own[self.leaf_terms] * self.repeats
        for made, left, right in self.levels:
            nodes[made] = nodes[left] + nodes[right]
        return np.add.reduceat(nodes[self.parts], self.starts, axis=0)


class Best:
    """The ``top`` best (score, doc_id) of each item, lower doc_ids first."""

    def __init__(self, items: int, top: int):
        self.top, self.found = top, [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in range(items)]
        self.least = np.zeros(items, np.int64)  # scores below this, or of 0, are not among the best

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        may = (scores > 0) & (scores >= self.least[:, None])
        for item in np.flatnonzero(may.any(axis=1)).tolist():
            at = np.flatnonzero(may[item])
            score = np.concatenate([self.found[item][0], scores[item, at]])
            doc = np.concatenate([self.found[item][1], ids[at]])
            order = np.lexsort((doc, -score))[:self.top]
            self.found[item] = score[order], doc[order]
            if len(order) == self.top:
                self.least[item] = score[order[-1]]


def _item_terms(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(stream):
        for i, text in enumerate(texts(batch.column(2))):
            found = Counter(alnum_words(text))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([list(found)], pa.list_(pa.binary())),
                     pa.array([list(found.values())], pa.list_(pa.int64()))], names=["item_id", "text_key", "terms", "repeats"])


_PLAN = "block long, text_keys array<long>, terms array<binary>, repeats array<long>, left array<long>, right array<long>, items array<array<long>>"


def _mined(schema: pa.Schema):
    def mined(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        graph = mine([list(zip(r["terms"], r["repeats"], strict=True)) for r in rows])
        return pa.Table.from_pylist([{
            "block": rows[0]["block"], "item_ids": [r["item_id"] for r in rows], "text_keys": [r["text_key"] for r in rows],
            "terms": [t for t, _ in graph.leaves], "repeats": [r for _, r in graph.leaves],
            "left": graph.left, "right": graph.right, "items": graph.items}], schema)
    return mined


def sharing_graphs(items: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """One row per block of items (item_id, text_key, terms, repeats): its
    sharing graph.  Items are dealt to blocks by hash, to more of them as long as one is too large."""
    total, many = items.agg(F.sum(F.size("terms")), F.count("*")).first()
    blocks = max(1, -(-(total or 0) // block_terms))
    while True:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text_key"), F.lit(blocks)))
        largest = dealt.groupBy("block").agg(F.sum(F.size("terms")).alias("n"), F.count("*").alias("k")).where("k > 1").agg(F.max("n")).first()[0]
        if blocks == 1 or (largest or 0) <= 2 * block_terms or blocks > 64 * many:
            break
        blocks *= 2
    item_type = items.schema["item_id"].dataType.simpleString()
    arrow = pa.schema([("block", pa.int64()), ("item_ids", pa.list_(_arrow(item_type))), ("text_keys", pa.list_(pa.int64())),
                       ("terms", pa.list_(pa.binary())), ("repeats", pa.list_(pa.int64())), ("left", pa.list_(pa.int64())),
                       ("right", pa.list_(pa.int64())), ("items", pa.list_(pa.list_(pa.int64())))])
    kind = _PLAN.replace("text_keys", f"item_ids array<{item_type}>, text_keys", 1)
    return dealt.groupBy("block").applyInArrow(_mined(arrow), kind)


def _arrow(simple: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(simple, pa.string())


def _postings(terms: list[bytes]):
    place = {t: i for i, t in enumerate(terms)}

    def postings(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            words = [alnum_words(t) for t in texts(batch.column(1))]
            lengths = np.array([len(w) for w in words], np.int64)
            known = np.concatenate([np.fromiter(map(place.get, w, repeat(-1)), np.int64, len(w)) for w in words])
            keys = np.repeat(np.arange(len(words)) * len(place), lengths) + known
            pairs, tf = np.unique(keys[known >= 0], return_counts=True)
            docs, found = np.divmod(pairs, max(1, len(place)))
            ends = pa.array(np.searchsorted(docs, np.arange(len(words) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths), pa.ListArray.from_arrays(ends, pa.array(found, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))], names=["doc_id", "n", "terms", "tf"])
    return postings


def _best(scorer: Accumulators, items: int, top: int):
    def best(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Best(items, top)
        for batch in batches(stream, scorer.rows):
            ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            terms, tf = batch.column(2), batch.column(3)
            docs = np.repeat(np.arange(batch.num_rows), terms.value_lengths().to_numpy(zero_copy_only=False))
            if len(docs):
                kept.add(scorer.scores(batch.column(1).to_numpy(), docs, terms.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy()), ids)
        sizes = [len(s) for s, _ in kept.found]
        doc = np.concatenate([d for _, d in kept.found])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(items), sizes), pa.int64()), pa.array(doc, pa.int64(), mask=doc == _NO_ID),
             pa.array(np.concatenate([s for s, _ in kept.found]), pa.int64())], names=["item", "doc_id", "score"])
    return best


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The ``top`` documents of each item: item_id, text_key (of the item's
    text), rank, doc_id (long) and score (long)."""
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    asked = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").alias("text"))
    item_type = asked.schema["item_id"].dataType.simpleString()
    if _arrow(item_type) == pa.string():
        asked, item_type = asked.withColumn("item_id", F.col("item_id").cast("string")), "string"
    asked = asked.select("item_id", text_key(F.col("text")).alias("text_key"), "text").dropDuplicates(["item_id", "text_key"])
    listed = stored(asked.mapInArrow(_item_terms, f"item_id {item_type}, text_key long, terms array<binary>, repeats array<long>"))
    graphs = stored(sharing_graphs(listed, block_terms))
    out = None
    for block, in graphs.select("block").collect():
        row = graphs.where(F.col("block") == block).first()  # one block of a checked size
        graph = Sharing([(bytes(t), r) for t, r in zip(row.terms, row.repeats, strict=True)], row.left, row.right, row["items"])
        terms = sorted({t for t, _ in graph.leaves})
        postings = stored(source.mapInArrow(_postings(terms), "doc_id long, n long, terms array<int>, tf array<long>"))
        n_docs, n_terms = postings.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        df = np.zeros(len(terms), np.int64)
        for term, n in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[term] = n
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        scorer = Accumulators(graph, terms, weights, n_docs, n_terms)
        found = postings.mapInArrow(_best(scorer, len(graph.items), top), "item long, doc_id long, score long")
        names = graphs.where(F.col("block") == block).select(F.posexplode(F.arrays_zip("item_ids", "text_keys")).alias("item", "x"))
        found = found.join(names, "item").select("x.item_ids", "x.text_keys", "doc_id", "score").toDF("item_id", "text_key", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = listed.select("item_id", "text_key", F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    order = F.desc("score"), F.asc_nulls_first("doc_id")
    salted = Window.partitionBy("item_id", "text_key", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS))).orderBy(*order)
    few = out.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top).drop("rank")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "text_key").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).select("item_id", "text_key", "rank", "doc_id", "score")
