"""Runs of words that repeat with a period, by seeds on diagonals.

A run is a stretch of consecutive words with smallest period q that is
``min_exponent`` periods and ``min_length`` words long at least and that no neighbouring
word extends with that period.  Words q apart are then equal on a stretch of
the diagonal of lag q that is at least o(q) = max(min_length - q,
(min_exponent - 1) q) long: the guaranteed overlap.

Lags are classed by powers of two.  For lags from 2^j to 2^(j+1) - 1 the
k-grams of the class are indexed, k being the least o(q) in the class, so every run
of the class holds seeds: a place i and a place i + q with the same k-gram.
As k is at least q, the same k-gram cannot occur between the two (q would not be
the smallest period), so it is enough to pair each occurrence with the
next one of its document: at most one pair a place and class, however often a
word or passage repeats.  Seeds are taken lag by lag from left to right.  Each
is extended both ways word by word; a table says how far a lag has been
covered, and seeds before that are passed over.

k-grams have exact integer names: windows of 2^a words are named by the pair
of names of their halves, a k-gram by the two windows that cover it, and
words by their bytes.  Windows that occur once in their document have no name and are not
looked at again.

Scale: one pass over the documents without any shuffle; no group, hot or not,
ever meets.  Memory is linear in the words of one document, or of the few
short ones that are worked on together.

Defined cases: a null or empty text has no words and no runs.  A null doc_id
is carried.  Rows repeating doc_id and text give a row each.  Further columns
are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gitquarry.llm.common import batches, texts

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Bytes of texts that are worked on together; a longer text is worked on alone.
_BYTES_AT_ONCE = 1 << 20


def _names(keys: np.ndarray, places: np.ndarray, total: int) -> np.ndarray:
    """For each of ``total`` places the number of its key, or -1 where the
    key occurs once or the place has none."""
    out = np.full(total, -1, np.int64)
    _, number, times = np.unique(keys, return_inverse=True, return_counts=True)
    again = times[number] > 1
    out[places[again]] = number[again]
    return out


def _covering(names: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and places of the k-grams that may repeat: pairs of names of the
    two windows of ``width`` words that cover them, width <= k <= 2 width."""
    shift = k - width
    left, right = names[:len(names) - shift], names[shift:]
    places = np.flatnonzero((left >= 0) & (right >= 0))
    return left[places] * (int(names.max(initial=0)) + 1) + right[places], places


def _same(codes: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many words from ``at`` on, rightwards (1) or leftwards (-1), equal
    those ``lag`` later."""
    reach, size = 0, 32
    room = len(codes) - lag - at if step == 1 else at + 1
    while reach < room:
        size = min(2 * size, room - reach)
        low = at + reach if step == 1 else at - reach - size + 1
        unequal = np.flatnonzero(codes[low:low + size] != codes[low + lag:low + lag + size])
        if len(unequal):
            return reach + (int(unequal[0]) if step == 1 else size - 1 - int(unequal[-1]))
        reach += size
    return reach


def _extended(codes: np.ndarray, seeds: np.ndarray, lags: np.ndarray, least) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the runs of one class."""
    order = np.lexsort((seeds, lags))
    seeds, lags = seeds[order], lags[order]
    bounds = np.flatnonzero(np.diff(lags, prepend=-1, append=-1))
    for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        lag, own, i = int(lags[first]), seeds[first:last], 0
        while i < len(own):
            at = int(own[i])
            covered = at + _same(codes, at, lag, 1)
            start = at + 1 - _same(codes, at, lag, -1) if covered > at else at
            if covered - start + lag >= least(lag):
                yield start, covered - start + lag, lag
            i = int(np.searchsorted(own, max(covered, at + 1)))


def _classes(longest: int, min_length: int, min_exponent: int) -> list[tuple[int, int]]:
    """(k, least lag) of the classes of lags that a run of ``longest`` words can have, by k."""
    out, low = [], 1
    while low * min_exponent <= longest:
        # from min_length on o(q) grows with q
        lags = range(low, min(2 * low, max(low, min_length) + 1))
        out.append((min(max(min_length - q, (min_exponent - 1) * q) for q in lags), low))
        low *= 2
    return sorted(out)


def runs_of(documents: list[list[bytes]], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each list of words, by start, then period."""
    sizes = np.array([len(w) for w in documents], np.int64)
    total, first = int(sizes.sum()), np.concatenate([[0], np.cumsum(sizes)])
    found: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    if not total:
        return found
    number: dict[bytes, int] = {}
    fresh = count()
    words = np.fromiter((number[w] if w in number else number.setdefault(w, next(fresh)) for w in chain.from_iterable(documents)),
                        np.int64, total)
    codes = np.repeat(np.arange(len(documents)), sizes) * len(number) + words  # equal words of two documents differ
    least = lambda q: max(min_length, min_exponent * q)
    names, width = _names(codes, np.arange(total), total), 1
    for k, low in _classes(int(sizes.max()), min_length, min_exponent):
        while 2 * width <= k and (names >= 0).any():
            keys, places = _covering(names, width, 2 * width)
            names, width = _names(keys, places, total), 2 * width
        if not (names >= 0).any():
            break
        keys, places = _covering(names, width, k)
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order]
        lags = np.diff(places)
        seeds = np.flatnonzero((keys[1:] == keys[:-1]) & (lags >= low) & (lags < 2 * low))
        for start, length, lag in _extended(codes, places[seeds], lags[seeds], least):
            doc = int(np.searchsorted(first, start, "right")) - 1
            found[doc].append((start - int(first[doc]), length, lag))
    return [sorted(own, key=lambda r: (r[0], r[2])) for own in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by blanks."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    return b" ".join(words[i] for i in np.flatnonzero(kept).tolist())


def _some(found: list[bytes]) -> Iterator[tuple[int, int]]:
    """Slices of texts of few bytes together, or a single longer one."""
    start = size = 0
    for i, text in enumerate(found):
        if i > start and size + len(text) > _BYTES_AT_ONCE:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(found):
        yield start, len(found)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
         min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (start, length,
    period; by start, then period) and the collapsed text."""
    if min_exponent < 3 or min_length < 2:
        raise ValueError("min_exponent must be 3 or more and min_length 2 or more")
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def found(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            whole = texts(batch.column(1))
            for low, high in _some(whole):
                words = [t.split() for t in whole[low:high]]
                runs = runs_of(words, min_length, min_exponent)
                short = [collapsed(w, r).decode() for w, r in zip(words, runs, strict=True)]
                listed = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in runs]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array([len(w) for w in words], pa.int64()),
                     pa.array(listed, pa.list_(run)), pa.array(short, pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])

    return source.mapInArrow(found, f"doc_id {id_type}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
