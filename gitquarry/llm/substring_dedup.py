"""Substring de-duplication by seed and extend on winnowed anchors.

A word is removed if it lies in a window of ``window`` consecutive words whose
word sequence also starts earlier: in a document with a smaller doc_id, or
further ahead in the same document.

Seed: winnowing picks one anchor, the smallest hash among the ``anchor``-word
runs inside it, for every window.  Equal windows pick the same anchor at the
same offset, so windows are compared only where anchors are equal.  Extend: an
anchor stands for the maximal stretch of consecutive windows that picked it,
reaching to both sides.  Three joins on ever longer keys follow:

1. anchors: those that occur once in all documents are dropped with their stretch;
2. stretches: all but the first of equal stretches are repeats as a whole;
3. windows: where different stretches share an anchor (the ends of a repeat),
   the first of each are compared window by window.

What repeats is joined to maximal intervals per document and cut out.

Scale: each join is one shuffle of (hashes, place), sorted and streamed.
Before it, map tasks sort bounded buffers and pass on one row per key and
buffer; the other rows of the key are already known to be repeats (or to
need the next join) and bypass the key.  So a passage that a third of all
documents hold reaches a task once per buffer, whatever its share.  No pairs
are formed.  Texts travel once, compressed, to meet their own intervals.  Keys
have 96 bits or more.

Defined cases: a null or empty text has no words.  A null doc_id counts as
smaller than all others.  Rows repeating doc_id and text are one document
and not repeats of each other; rows sharing a doc_id with other texts are
ordered by a hash of the text.  Texts shorter than a window are kept whole.
Ids must be integers.  Further columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gitquarry.llm.common import batches, run_hashes, stored, text_keys, texts, word_hashes

WINDOW = 20
ANCHOR = 8
BUFFER_ROWS = 400_000
_NO_ID = -(1 << 63)

#: What a row is: an anchor alone in its buffer, several with equal or with
#: different stretches, one that bypasses the key, or an interval to remove.
ALONE, EQUAL, MIXED, BYPASS, REMOVE = range(5)

#: place: 32 bits that tell apart texts of one doc_id, then the first word's number.
#: shape: the anchor's offset and the number of windows.  windows: 32 bits each.
ROW = pa.schema([("kind", pa.int8()), ("anchor", pa.int64()), ("doc", pa.int64()), ("place", pa.int64()),
                 ("shape", pa.int32()), ("windows", pa.binary())])
NEXT = pa.schema([("kind", pa.int8()), ("anchor", pa.int64()), ("stretch", pa.int64()), ("doc", pa.int64()),
                  ("place", pa.int64()), ("shape", pa.int32()), ("windows", pa.binary())])
LAST = pa.schema([("kind", pa.int8()), ("anchor", pa.int64()), ("stretch", pa.int64()), ("doc", pa.int64()),
                  ("place", pa.int64()), ("n", pa.int32())])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int8(): "byte", pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def stretches(hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of each anchor: its hash, its first window, its offset from there and
    the number of windows; and the hashes of all windows."""
    runs, windows = run_hashes(hashes, anchor), run_hashes(hashes, window)
    if not len(windows):
        return (windows, *[np.empty(0, np.int64)] * 3, windows)
    width = window - anchor + 1
    seen = np.lib.stride_tricks.sliding_window_view(runs, width)
    picked = np.concatenate([seen[i:i + (1 << 16)].argmin(axis=1) for i in range(0, len(seen), 1 << 16)]) + np.arange(len(windows))
    first = np.flatnonzero(np.append(True, picked[1:] != picked[:-1]))
    return runs[picked[first]], first, picked[first] - first, np.diff(np.append(first, len(windows))), windows


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """uint32 values as one binary value per count."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * 4
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All uint32 values of binary values, and where each value's begin."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1] // 4
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint32, len(data) // 4) if data is not None and len(data) else np.empty(0, np.uint32)), offsets


def _stretch_keys(part: Flat) -> np.ndarray:
    """The first and last window cover a stretch, so they tell it apart."""
    values, at = _values(part["windows"])
    first, last = values[at[:-1]].astype(np.uint64), values[at[1:] - 1].astype(np.uint64)
    key = (first << np.uint64(32) | last) ^ _column(part, "shape").astype(np.uint64) * _MIX
    return key.view(np.int64)


def _column(part: Flat, name: str) -> np.ndarray:
    return part[name].to_numpy(zero_copy_only=False)


class Flat(dict):
    """Columns of a batch by name, one Arrow array each."""

    def take(self, at: np.ndarray) -> Flat:
        return Flat({k: v.take(pa.array(at)) for k, v in self.items()})

    def __len__(self) -> int:
        return len(self["doc"])

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([self[f.name].cast(f.type) for f in schema], schema=schema)


def _joined(parts: list[Flat]) -> Flat:
    return Flat({k: pa.concat_arrays([p[k] for p in parts]) for k in parts[0]})


def _buffered(stream: Iterator[Flat], rows: int) -> Iterator[Flat]:
    parts, n = [], 0
    for part in stream:
        if len(part):
            parts.append(part)
            n += len(part)
        if n >= rows:
            yield _joined(parts)
            parts, n = [], 0
    if parts:
        yield _joined(parts)


def _whole_runs(stream: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[Flat]:
    """Sorted batches cut so that rows of equal keys stay together."""
    kept = None
    for batch in stream:
        part = Flat(zip(batch.schema.names, batch.columns, strict=True))
        if not len(part):
            continue
        part = _joined([kept, part]) if kept is not None else part
        last = int(np.flatnonzero(_new([_column(part, k) for k in keys]))[-1])
        kept = part.take(np.arange(last, len(part)))
        if last:
            yield part.take(np.arange(last))
    if kept is not None:
        yield kept


def _new(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), bool)
    if len(out):
        out[0] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _first_of_key(part: Flat, keys: list[str]) -> tuple[Flat, np.ndarray, np.ndarray]:
    """Rows sorted by keys, doc and place; which are the first of their key,
    and which are others elsewhere (not the same place listed again)."""
    columns = [_column(part, k) for k in [*keys, "doc", "place"]]
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = _new(columns[:-2])
    start = np.flatnonzero(new)[np.cumsum(new) - 1]
    elsewhere = (columns[-2] != columns[-2][start]) | (columns[-1] != columns[-1][start])
    return part.take(order), new, ~new & elsewhere


def _removed(part: Flat, at: np.ndarray) -> Flat:
    gone = part.take(at)
    if "shape" in gone and "windows" in gone:
        gone["windows"] = pa.nulls(len(at), pa.binary())
    gone["kind"] = pa.array(np.full(len(at), REMOVE, np.int8))
    return gone


def _anchored(window: int, anchor: int, buffer_rows: int):
    """Documents to rows of ROW, one per anchor and buffer."""
    def found(stream: Iterator[pa.RecordBatch]) -> Iterator[Flat]:
        for batch in batches(stream):
            some = texts(batch.column(1))
            ids = batch.column(0).cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            parts = []
            for doc, key, text in zip(ids.tolist(), text_keys(some).tolist(), some, strict=True):
                hashes, first, offset, n, windows = stretches(word_hashes(text.split()), window, anchor)
                if len(hashes):
                    parts.append((hashes, np.full(len(first), doc), (key >> 32 << 32) + first, offset << 8 | n, n,
                                  (windows >> np.uint64(32)).astype(np.uint32)))
            if parts:
                a, doc, place, shape, n, windows = (np.concatenate([p[i] for p in parts]) for i in range(6))
                yield Flat(kind=pa.array(np.zeros(len(a), np.int8)), anchor=pa.array(a.view(np.int64)), doc=pa.array(doc),
                           place=pa.array(place), shape=pa.array(shape.astype(np.int32)), windows=_binary(windows, n))

    def anchored(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _buffered(found(stream), buffer_rows):
            part["stretch"] = pa.array(_stretch_keys(part))
            part, first, elsewhere = _first_of_key(part, ["anchor", "stretch"])
            new = _new([_column(part, "anchor")])
            run = np.cumsum(new) - 1
            several = np.bincount(run)[run] > 1
            mixed = np.bincount(run, weights=first)[run] > 1
            kind = np.where(new, np.where(mixed, MIXED, np.where(several, EQUAL, ALONE)), BYPASS)
            part["kind"] = pa.array(kind.astype(np.int8))
            yield part.take(np.flatnonzero(first)).batch(ROW)
            yield _removed(part, np.flatnonzero(elsewhere)).batch(ROW)
    return anchored


def _repeated(buffer_rows: int):
    """Rows of ROW sorted by anchor, to rows of NEXT: one per stretch and
    buffer, of anchors that occur again; kind MIXED or EQUAL."""
    def again(stream: Iterator[pa.RecordBatch]) -> Iterator[Flat]:
        for part in _whole_runs(stream, ["anchor"]):
            kind = _column(part, "kind")
            live = part.take(np.flatnonzero(kind < REMOVE))
            if len(live):
                live["stretch"] = pa.array(_stretch_keys(live))
                kind, key = _column(live, "kind"), _column(live, "stretch")
                run = np.cumsum(_new([_column(live, "anchor")])) - 1
                witness = kind <= MIXED
                many = np.bincount(run, weights=np.where(witness, np.where(kind == ALONE, 1, 2), 0))[run] > 1
                at = np.flatnonzero(witness)
                reference = np.zeros(run[-1] + 1, np.int64)
                reference[run[at]] = key[at]
                differs = np.bincount(run, weights=witness & ((kind == MIXED) | (key != reference[run])))[run] > 0
                live["kind"] = pa.array(np.where(differs | (kind == BYPASS), MIXED, EQUAL).astype(np.int8))
                yield live.take(np.flatnonzero((witness & many) | (kind == BYPASS)))
            gone = part.take(np.flatnonzero(_column(part, "kind") == REMOVE))
            gone["stretch"] = gone["anchor"]
            yield gone

    def repeated(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _buffered(again(stream), buffer_rows):
            yield from (x.batch(NEXT) for x in _first_stretches(part))
    return repeated


def _first_stretches(part: Flat) -> Iterator[Flat]:
    """The first of each stretch, which is MIXED if any is; the others and what was to be removed before as REMOVE."""
    gone = _column(part, "kind") == REMOVE
    yield part.take(np.flatnonzero(gone))
    live = part.take(np.flatnonzero(~gone))
    if len(live):
        live, first, elsewhere = _first_of_key(live, ["anchor", "stretch"])
        run = np.cumsum(first) - 1
        mixed = np.bincount(run, weights=_column(live, "kind") == MIXED)[run] > 0
        live["kind"] = pa.array(np.where(mixed, MIXED, EQUAL).astype(np.int8))
        yield live.take(np.flatnonzero(first))
        yield _removed(live, np.flatnonzero(elsewhere))


def _single_windows(part: Flat) -> Flat:
    """The windows of stretches as rows of their own; stretch becomes the window's key."""
    values, at = _values(part["windows"])
    n = np.diff(at)
    row = np.repeat(np.arange(len(part)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    offset = (_column(part, "shape") >> 8)[row] - place
    key = offset.astype(np.int64) << 32 | values[at[0]:at[-1]].astype(np.int64)
    out = part.take(row)
    return Flat(kind=out["kind"], anchor=out["anchor"], stretch=pa.array(key), doc=out["doc"],
                place=pa.array(_column(out, "place") + place), n=pa.array(np.ones(len(row), np.int32)))


def _counted(part: Flat) -> Flat:
    return Flat(kind=part["kind"], anchor=part["anchor"], stretch=part["stretch"], doc=part["doc"], place=part["place"],
                n=pa.array(_column(part, "shape") & 255))


def _compared(buffer_rows: int):
    """Rows of NEXT sorted by anchor, stretch, doc and place, to rows of LAST:
    intervals to remove, and the windows still to be compared."""
    def kept(stream: Iterator[pa.RecordBatch], gone: list[Flat]) -> Iterator[Flat]:
        for part in _whole_runs(stream, ["anchor", "stretch"]):
            for some in _first_stretches(part):
                kind = _column(some, "kind")
                removed = some.take(np.flatnonzero(kind == REMOVE))
                if len(removed):
                    gone.append(_counted(removed))
                mixed = some.take(np.flatnonzero(kind == MIXED))
                if len(mixed):
                    yield _single_windows(mixed)
            if gone:
                yield Flat({f.name: pa.nulls(0, f.type) for f in LAST})

    def compared(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone: list[Flat] = []
        parts, n = [], 0
        for part in kept(stream, gone):
            if gone:
                yield _joined(gone).batch(LAST)
                gone.clear()
            if len(part):
                parts.append(part)
                n += len(part)
            if n >= buffer_rows:
                yield from (x.batch(LAST) for x in _first_windows(_joined(parts)))
                parts, n = [], 0
        if gone:
            yield _joined(gone).batch(LAST)
        if parts:
            yield from (x.batch(LAST) for x in _first_windows(_joined(parts)))
    return compared


def _first_windows(part: Flat) -> Iterator[Flat]:
    part, first, elsewhere = _first_of_key(part, ["anchor", "stretch"])
    yield part.take(np.flatnonzero(first))
    yield _removed(part, np.flatnonzero(elsewhere))


def _last(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _whole_runs(stream, ["anchor", "stretch"]):
        *_, gone = _first_windows(part)
        yield gone.batch(LAST)


def _dealt(df: DataFrame, keys: list[str], by_key) -> DataFrame:
    """Rows of one key in one partition; rows that bypass the key anywhere."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (df.repartition(parts, F.when(by_key, F.xxhash64(*keys)).otherwise(F.xxhash64("doc", "place")))
            .sortWithinPartitions(*keys, "doc", "place"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR,
            buffer_rows: int = BUFFER_ROWS) -> DataFrame:
    """(doc, tag, spans): the intervals of words to remove from each text;
    tag is the upper half of its text_key."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    anchors = source.mapInArrow(_anchored(window, anchor, buffer_rows), _ddl(ROW))
    again = _dealt(anchors, ["anchor"], F.col("kind") <= MIXED).mapInArrow(_repeated(buffer_rows), _ddl(NEXT))
    compared = stored(_dealt(again, ["anchor", "stretch"], F.col("kind") < REMOVE).mapInArrow(_compared(buffer_rows), _ddl(LAST)))
    singles = _dealt(compared.where(F.col("kind") < REMOVE), ["anchor", "stretch"], F.lit(True)).mapInArrow(_last, _ddl(LAST))
    gone = compared.where(F.col("kind") == REMOVE).unionByName(singles)
    start = F.col("place").bitwiseAND((1 << 32) - 1)
    return (gone.groupBy("doc", F.shiftright("place", 32).alias("tag"))
            .agg(F.collect_list(F.struct(start.alias("start"), (start + F.col("n") + window - 1).alias("end"))).alias("spans")))


def _zipped(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd")
    for batch in batches(stream):
        found = texts(batch.column(1))
        ids = batch.column(0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [ids, ids.fill_null(_NO_ID), pa.array(text_keys(found) >> 32), pa.array([len(t) for t in found], pa.int64()),
             pa.array([codec.compress(t, asbytes=True) for t in found], pa.binary())],
            names=["doc_id", "doc", "tag", "size", "zipped"])


def _cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd")
    for batch in batches(stream):
        n_words, n_removed, kept = [], [], []
        for size, zipped, spans in zip(*(batch.column(c).to_pylist() for c in ("size", "zipped", "spans")), strict=True):
            words = codec.decompress(zipped, size, asbytes=True).split() if size else []
            n_words.append(len(words))
            if spans:
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, [s["start"] for s in spans], 1)
                np.add.at(edge, [s["end"] for s in spans], -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_text"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    anchor: int = ANCHOR, buffer_rows: int = BUFFER_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed and kept_text."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    whole = source.mapInArrow(_zipped, "doc_id long, doc long, tag long, size long, zipped binary")
    spans = stored(repeats(docs, id_col, text_col, window, anchor, buffer_rows))
    return (whole.join(spans, ["doc", "tag"], "left").select("doc_id", "size", "zipped", "spans")
            .mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_text string"))
