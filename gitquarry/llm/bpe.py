"""Byte-level BPE by monoid tree reduction.

The ids of a text form a monoid: a text is cut in halves down to short
leaves, the leaves are encoded by themselves, and neighbours are joined up the
tree.  A join re-encodes a window around the boundary and widens it until what
lies outside provably stays as it is, on two levels:

* Pieces of the pre-tokeniser's pattern.  Whether a match stands depends on
  the text from its start to a few characters beyond its end only (``AHEAD``).
  So a left neighbour's pieces stand but for its last ones, and as soon as a
  match of the window ends where a piece of the right neighbour starts, all
  its further pieces stand.
* Tokens inside a piece.  Ids are the encoding of their bytes exactly if each
  two neighbours are the encoding of theirs: up to the first merge over a
  boundary between two tokens, merges inside both run in the order in which they run
  when the two tokens stand alone.  So the window's first and last ids are
  tested with the ids beside them, and the window doubles on a side that fails.

Decoding concatenates the bytes of halves up the same tree.

Scale: texts of up to ``segment`` characters are encoded where they are read,
without a shuffle.  Longer ones are cut into segments that are dealt out to all
tasks, encoded there, and joined by pairs in logarithmically many rounds; only
those are shuffled, and a group holds two rows.  A worker remembers the ids of
short pieces in a bounded table.

Defined cases: a null text counts as empty and has no ids.  A null doc_id is
carried.  Rows repeating doc_id and text give a row each.  Further columns are
ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gitquarry.llm.common import batches, stored, text_key, text_keys, texts, worker_state

#: Characters of a text that is a leaf of the tree, and bytes of a piece that is one.
LEAF, PIECE_LEAF = 4096, 128
#: Characters of a text that is encoded in one task.
SEGMENT = 1 << 16
#: A match depends on the text up to so many characters beyond its end, and from its start.
#: Fixed by the pattern: a run of blanks looks two characters on, a contraction is three long.
AHEAD, AT_LEAST = 2, 3
_MOST_PIECES, _MOST_PAIRS, _LONGEST_PIECE = 500_000, 50_000, 48
#: Bytes of a piece whose pairs are all looked at before each merge.
_FEW = 64
_NO_RANK = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with a base64 token and a rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@dataclass
class Part:
    """Ids of a text as little-endian 32-bit numbers, and how many each piece has."""

    ids: bytes
    sizes: np.ndarray


class _Remembered(dict):
    """Ids of short pieces, ``most`` of them at most: when half of them are
    new, the older half goes, but for what has been used since."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.half, self.older = make, max(1, most // 2), {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.make(piece.encode())
        if len(piece) <= _LONGEST_PIECE:
            if len(self) >= self.half:
                self.older = {}  # gone before the newer half is copied
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, piece_leaf: int = PIECE_LEAF,
                 most: int = _MOST_PIECES):
        self.ranks, self.pattern, self.leaf, self.piece_leaf = ranks, regex.compile(pattern), leaf, piece_leaf
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.pieces = _Remembered(self.piece, most)
        self.stands: dict[tuple[int, int], bool] = {}

    # tokens of one piece

    def merged(self, piece: bytes) -> list[int]:
        """Ids by merging the neighbours of lowest rank, the leftmost first."""
        return self._merged_few(piece) if len(piece) <= _FEW else self._merged_many(piece)

    def _merged_few(self, piece: bytes) -> list[int]:
        """By looking at all pairs before each merge."""
        get = self.ranks.get
        parts = [piece[i:i + 1] for i in range(len(piece))]
        pairs = [get(piece[i:i + 2], _NO_RANK) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) < _NO_RANK:
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], _NO_RANK)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], _NO_RANK)
        return [self.ranks[p] for p in parts]

    def _merged_many(self, piece: bytes) -> list[int]:
        """By a heap of pairs."""
        n, ranks = len(piece), self.ranks
        after, before, live = list(range(1, n + 2)), list(range(-1, n + 1)), bytearray(b"\1" * n)
        waiting = [(ranks[piece[i:i + 2]], i, i + 2) for i in range(n - 1) if piece[i:i + 2] in ranks]
        heapify(waiting)
        while waiting:
            _, i, end = heappop(waiting)
            if not live[i] or (j := after[i]) >= n or after[j] != end:
                continue  # one of the two has been merged since
            live[j], after[i] = 0, end
            if end < n:
                before[end] = i
                if (rank := ranks.get(piece[i:after[end]])) is not None:
                    heappush(waiting, (rank, i, after[end]))
            if i and (rank := ranks.get(piece[before[i]:end])) is not None:
                heappush(waiting, (rank, before[i], end))
        return [ranks[piece[i:after[i]]] for i in range(n) if live[i]]

    def stand(self, left: int, right: int) -> bool:
        """Whether two tokens beside each other are the encoding of their bytes."""
        key = left, right
        known = self.stands.get(key)
        if known is None:
            if len(self.stands) > _MOST_PAIRS:
                self.stands.clear()
            known = self.stands[key] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def join_tokens(self, left: bytes, right: bytes) -> bytes:
        """Ids of one piece from the ids of its two parts."""
        a, b = np.frombuffer(left, "<u4"), np.frombuffer(right, "<u4")
        i, j = min(1, len(a)), min(1, len(b))
        while True:
            window = self.merged(self.bytes_of(a[len(a) - i:]) + self.bytes_of(b[:j]))
            left_stands = i == len(a) or not window or self.stand(int(a[-i - 1]), window[0])
            right_stands = j == len(b) or not window or self.stand(window[-1], int(b[j]))
            if left_stands and right_stands:
                return left[:4 * (len(a) - i)] + _packed(window) + right[4 * j:]
            i = i if left_stands else min(len(a), 2 * i)
            j = j if right_stands else min(len(b), 2 * j)

    def _halves(self, piece: bytes) -> bytes:
        if len(piece) <= self.piece_leaf:
            return _packed(self.merged(piece))
        middle = len(piece) // 2
        return self.join_tokens(self._halves(piece[:middle]), self._halves(piece[middle:]))

    def piece(self, piece: bytes) -> bytes:
        whole = self.ranks.get(piece)
        return self._halves(piece) if whole is None else _packed([whole])

    # pieces of a text

    def encode(self, text: str) -> Part:
        if len(text) > self.leaf:
            middle = len(text) // 2
            return self.join(self.encode(text[:middle]), self.encode(text[middle:]))
        found = list(map(self.pieces.__getitem__, self.pattern.findall(text)))
        return Part(b"".join(found), np.fromiter(map(len, found), np.int64, len(found)) // 4)

    def ids_of(self, text: str) -> bytes:
        """The ids alone."""
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text))) if len(text) <= self.leaf else self.encode(text).ids

    def join(self, left: Part, right: Part) -> Part:
        """The text of ``left`` followed by that of ``right``."""
        if not len(left.sizes) or not len(right.sizes):
            return right if not len(left.sizes) else left
        tail, beyond, cut = [], 0, len(left.ids)  # the last pieces of the left, which may not stand
        while len(tail) < len(left.sizes):
            size = int(left.sizes[-1 - len(tail)])
            piece = self.decode(left.ids[cut - 4 * size:cut]).decode()
            if beyond >= AHEAD and beyond + len(piece) >= AT_LEAST:
                break
            tail.append(piece)
            beyond, cut = beyond + len(piece), cut - 4 * size
        tail.reverse()
        head: list[str] = []
        ends = np.cumsum(right.sizes) * 4
        while True:
            for k in range(len(head), min(len(right.sizes), max(1, 2 * len(head)))):
                head.append(self.decode(right.ids[int(ends[k - 1]) if k else 0:int(ends[k])]).decode())
            starts = dict(zip(np.cumsum([beyond, *map(len, head)]).tolist(), range(len(head) + 1), strict=True))
            window, whole = "".join(tail + head), len(head) == len(right.sizes)
            made, sizes, meets = [], [], None
            for match in self.pattern.finditer(window):
                if not whole and len(window) < max(match.end() + AHEAD, match.start() + AT_LEAST):
                    break
                if match.start() == beyond - len(tail[-1]) and match.end() == beyond + len(head[0]):
                    # the two pieces at the boundary have become one
                    last, first = 4 * int(left.sizes[-1]), int(ends[0])
                    rank = self.ranks.get(match.group().encode())
                    made.append(self.join_tokens(left.ids[-last:], right.ids[:first]) if rank is None else _packed([rank]))
                else:
                    made.append(self.pieces[match.group()])
                sizes.append(len(made[-1]) // 4)
                meets = starts.get(match.end())
                if meets is not None:
                    break
            if meets is not None:
                break
        at = int(ends[meets - 1]) if meets else 0
        return Part(left.ids[:cut] + b"".join(made) + right.ids[at:],
                    np.concatenate([left.sizes[:len(left.sizes) - len(tail)], np.array(sizes, np.int64), right.sizes[meets:]]))

    # bytes

    def bytes_of(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes, concatenated up a tree of halves."""
        if len(ids) <= self.leaf:
            return b"".join(map(self.tokens.__getitem__, ids.tolist()))
        middle = len(ids) // 2
        return self.bytes_of(ids[:middle]) + self.bytes_of(ids[middle:])

    def decode(self, ids: bytes) -> bytes:
        return self.bytes_of(np.frombuffer(ids, "<u4"))


def _codec(path: str, pattern: str) -> Codec:
    return worker_state(("bpe", path, pattern), lambda: Codec(read_ranks(path), pattern))


def _whole(path: str, pattern: str):
    def whole(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            codec = _codec(path, pattern)
            ids = [codec.ids_of(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
    return whole


def _cut(segment: int):
    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, 1):
            found = texts(batch.column(1))
            key, text = int(text_keys(found)[0]), found[0].decode()
            for seq in range(0, len(text), segment):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([key], pa.int64()), pa.array([seq // segment], pa.int64()),
                     pa.array([-(-len(text) // segment)], pa.int64()), pa.array([text[seq:seq + segment]])],
                    names=["doc_id", "text_key", "seq", "n", "text"])
    return cut


def _leaves(path: str, pattern: str):
    def leaves(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, 16):
            codec = _codec(path, pattern)
            parts = [codec.encode(t.decode()) for t in texts(batch.column(4))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array([p.ids for p in parts], pa.binary()), pa.array([p.sizes.tobytes() for p in parts], pa.binary())],
                names=["doc_id", "text_key", "seq", "n", "ids", "sizes"])
    return leaves


def _pairs(path: str, pattern: str):
    def pairs(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, 16):
            codec, parts = _codec(path, pattern), []
            for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                left, right = (Part(x["ids"], np.frombuffer(x["sizes"], np.int64)) if x else None for x in (a, b))
                parts.append(left if right is None else codec.join(left, right))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array([p.ids for p in parts], pa.binary()), pa.array([p.sizes.tobytes() for p in parts], pa.binary())],
                names=["doc_id", "text_key", "seq", "n", "ids", "sizes"])
    return pairs


def _long(source: DataFrame, path: str, pattern: str, segment: int) -> DataFrame:
    """(doc_id, ids) of texts of several segments."""
    id_type = source.schema["doc_id"].dataType.simpleString()
    keys = f"doc_id {id_type}, text_key long, seq long, n long"
    part = f"{keys}, ids binary, sizes binary"
    rows = source.select("doc_id", text_key(F.col("text")).alias("row_key"))
    cut = source.mapInArrow(_cut(segment), f"{keys}, text string").dropDuplicates(["doc_id", "text_key", "seq"])
    current = stored(cut.mapInArrow(_leaves(path, pattern), part))
    most = current.agg(F.max("n")).first()[0] or 1
    while most > 1:
        even, both = F.col("seq") % 2 == 0, F.struct("ids", "sizes")
        pairs = (current.groupBy("doc_id", "text_key", F.floor(F.col("seq") / 2).alias("seq"))
                 .agg(F.max(F.floor((F.col("n") + 1) / 2)).alias("n"),
                      F.max(F.when(even, both)).alias("left"), F.max(F.when(~even, both)).alias("right")))
        current = stored(pairs.mapInArrow(_pairs(path, pattern), part))
        most = (most + 1) // 2
    same = rows["doc_id"].eqNullSafe(current["doc_id"]) & (rows["row_key"] == current["text_key"])
    return rows.join(current, same).select(rows["doc_id"], "ids")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           segment: int = SEGMENT) -> DataFrame:
    """One row per row of ``docs``: doc_id and ids (little-endian unsigned
    32-bit numbers)."""
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    is_long = F.coalesce(F.length("text"), F.lit(0)) > segment
    short = source.where(~is_long).mapInArrow(_whole(path, pattern), f"doc_id {id_type}, ids binary")
    return short.unionByName(_long(source.where(is_long), path, pattern, segment))


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with the decoded bytes of its ids as a further column
    ``decoded``.  Null ids are decoded to no bytes."""
    rows = encoded.select(F.struct(*[F.col(f"`{c}`") for c in encoded.columns]).alias("row"), F.col(f"`{ids_col}`").alias("ids"))

    def decoded(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            codec = _codec(path, pattern)
            found = [codec.decode(ids or b"") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["row", "decoded"])

    kind = f"row {rows.schema['row'].dataType.simpleString()}, decoded binary"
    return rows.mapInArrow(decoded, kind).select("row.*", "decoded")
