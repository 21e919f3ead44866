"""Harmonic packing of tokenised documents into fixed-length sequences.

Lengths are classed by the reciprocal of the capacity they fit: class j holds
lengths over capacity/(j+1) and up to capacity/j, the last class all shorter
ones.  A bin of class j always takes j documents, so a worker fills it
without knowing any other worker's bins.  Documents may be cut, and that
removes the loss for which harmonic packing is known: what a full bin leaves
free is filled with the head of a following document, whose rest fills the
next gaps.  A document of more than a whole sequence first fills sequences of
its own.  What a worker holds at its end is laid end to end and cut into
sequences, the last of them into powers of two, which need no padding.

Scale: one pass over the documents without any shuffle.  A worker holds at most
one open bin per class.  Ids of sequences combine partition and place, so a
repeated task gives the same rows.  Pieces of words are tokenised once and kept by the worker,
over tasks, in a bounded table; the vocabulary's merges never cross its pre-tokeniser's pieces.

Defined cases: a null or empty text is the single end id.  Rows repeating a
doc_id are packed each.  A null doc_id is carried.  Further columns are
ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from gitquarry.llm.common import batches, texts, worker_state

CAPACITY = 2048
CLASSES = 16
END_ID = 1
_MOST_PIECES = 700_000


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write the characters U+0000 to U+00FF:
    each UTF-8 byte as a letter of its own, visible ones as themselves."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in visible}
    letters |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}
    return {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}


class _Numbers(dict):
    """Numbers keys in the order in which they are first looked up."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


class PieceTokens:
    """Token ids of texts.  A text's ids are those of the pieces into which
    the vocabulary's pre-tokeniser cuts it, and each piece is tokenised once
    and remembered, ``most`` of them.  Words beyond Latin-1, and those that may
    hold a special token, are pieces of their own for the whole tokeniser."""

    # The vocabulary's pieces, for lower-case letters and digits of Latin-1.
    _LETTERS, _DIGITS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
    _PIECES = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_DIGITS}]|[^{_LETTERS}{_DIGITS}\t-\r\x20]+")
    _ODD = re.compile("<\\||[^\t-\r\x20-\x7e\xa1-\xff]")
    _WHOLE = "\x00"  # marks a word for the whole tokeniser

    def __init__(self, path: str, most: int = _MOST_PIECES):
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces_only = Tokenizer(self.tokenizer.model)
        self.pieces_only.pre_tokenizer = WhitespaceSplit()
        self.letters = _byte_letters() | {32: " "}
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.number = _Numbers()
        self.known = 0
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool, self.used = np.zeros(1 << 18, np.int32), 0

    def _pieces(self, text: bytes) -> list[str]:
        whole = text.decode()
        if not self._ODD.search(whole):
            return self._PIECES.findall(whole.lower())
        out: list[str] = []
        for word in map(bytes.decode, text.split()):
            out += [self._WHOLE + word] if self._ODD.search(word) else self._PIECES.findall(word.lower())
        return out

    def _put(self, numbers: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.starts[numbers] = self.used + np.cumsum(lengths) - lengths
        self.lengths[numbers] = lengths
        self.pool[self.used:self.used + len(ids)] = ids
        self.used += len(ids)

    def learn(self) -> None:
        """The ids of the keys that have a number but no ids yet."""
        keys = list(islice(reversed(self.number), len(self.number) - self.known))[::-1]
        while len(self.number) > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        numbers = np.arange(self.known, len(self.number))
        whole = np.fromiter((k[0] == self._WHOLE for k in keys), bool, len(keys))
        if whole.any():
            found = self.tokenizer.encode_batch_fast([k[1:] for k in keys if k[0] == self._WHOLE], add_special_tokens=False)
            lengths = np.array([len(e.ids) for e in found])
            self._put(numbers[whole], lengths, np.fromiter(chain.from_iterable(e.ids for e in found), np.int32, lengths.sum()))
            numbers, keys = numbers[~whole], [k for k in keys if k[0] != self._WHOLE]
        if keys:
            found = self.pieces_only.encode(" ".join(keys).translate(self.letters), add_special_tokens=False)
            self._put(numbers, np.bincount(np.array(found.word_ids, np.int64), minlength=len(keys)), np.array(found.ids, np.int32))
        self.known = len(self.number)

    def encode(self, some: list[bytes]) -> list[np.ndarray]:
        if self.known > self.most:
            self.forget()
        pieces = [self._pieces(t) for t in some]
        counts = list(map(len, pieces))
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(pieces)), np.int64, sum(counts))
        if len(self.number) > self.known:
            self.learn()
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        flat = self.pool[np.repeat(self.starts[at] - ends + lengths, lengths) + np.arange(int(lengths.sum()))]
        of_text = np.concatenate([[0], ends])[np.cumsum([0, *counts])]
        return [flat[i:j] for i, j in zip(of_text[:-1].tolist(), of_text[1:].tolist(), strict=True)]


class Packer:
    """Packs (key, ids) one after another; ``add`` and ``end`` give finished
    sequences as lists of pieces (key, start, ids)."""

    def __init__(self, capacity: int = CAPACITY, classes: int = CLASSES):
        self.capacity, self.classes = capacity, classes
        self.open: dict[int, list[tuple]] = {}
        self.filler: tuple | None = None  # the rest of a document that fills gaps
        self.waiting: tuple[list[tuple], int] | None = None  # a full bin, and what it has free

    def add(self, key, ids: np.ndarray) -> Iterator[list[tuple]]:
        whole = len(ids) // self.capacity * self.capacity
        for at in range(0, whole, self.capacity):
            yield [(key, at, ids[at:at + self.capacity])]
        if whole == len(ids):
            return
        rest = (key, whole, ids[whole:])
        if self.waiting:
            self.filler = rest
            yield from self._fill()
            return
        kind = min(self.capacity // len(rest[2]), self.classes)
        pieces = self.open.setdefault(kind, [])
        pieces.append(rest)
        if len(pieces) == kind:
            del self.open[kind]
            self.waiting = (pieces, self.capacity - sum(len(p[2]) for p in pieces))
            yield from self._fill()

    def _fill(self) -> Iterator[list[tuple]]:
        pieces, free = self.waiting
        if free and self.filler:
            key, start, ids = self.filler
            head, tail = ids[:free], ids[free:]
            pieces.append((key, start, head))
            free -= len(head)
            self.filler = (key, start + len(head), tail) if len(tail) else None
        self.waiting = (pieces, free) if free else None
        if not free:
            yield pieces

    def end(self) -> Iterator[list[tuple]]:
        left = [p for pieces in self.open.values() for p in pieces]
        left += (self.waiting[0] if self.waiting else []) + ([self.filler] if self.filler else [])
        total = sum(len(p[2]) for p in left)
        sizes = [self.capacity] * (total // self.capacity)
        rest = total % self.capacity
        sizes += [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]
        at = 0
        for size in sizes:
            pieces = []
            while size:
                key, start, ids = left[at]
                head = ids[:size]
                pieces.append((key, start, head))
                size -= len(head)
                if len(head) < len(ids):
                    left[at] = (key, start + len(head), ids[len(head):])
                else:
                    at += 1
            yield pieces
        self.__init__(self.capacity, self.classes)


def _pack(vocabulary: str, capacity: int, classes: int):
    def pack(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker_state(("tokens", vocabulary), lambda: PieceTokens(vocabulary))
        packer = Packer(capacity, classes)
        sequence = TaskContext.get().partitionId() << 40
        id_type, rows = pa.int64(), []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], id_type), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 6)),
                 pa.array([r[6] for r in rows], pa.binary())],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            rows.clear()
            return out

        def put(sequences) -> None:
            nonlocal sequence
            for pieces in sequences:
                offset = 0
                for (doc_id, n), start, ids in pieces:
                    rows.append((doc_id, start, len(ids), n, sequence, offset, ids.astype("<u4").tobytes()))
                    offset += len(ids)
                sequence += 1

        for batch in batches(stream, 64):
            id_type = batch.column(0).type
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokens.encode(texts(batch.column(1))), strict=True):
                ids = np.append(ids, np.int32(END_ID))
                put(packer.add((doc_id, len(ids)), ids))
            if len(rows) >= 256:
                yield flush()
        put(packer.end())
        if rows:
            yield flush()
    return pack


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, classes: int = CLASSES) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id,
    offset and ids (little-endian unsigned 32-bit)."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        _pack(vocabulary, capacity, classes),
        f"doc_id {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
