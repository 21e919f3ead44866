"""Sampling and splits.

Spark's ``sample`` / ``randomSplit`` draw per partition, so their result
depends on the partitioning.  The default here is a key-hash draw: each
row's position in [0, 1) comes from the first hex digits of
``md5(key columns || seed)``, so every engine and every partitioning gives
the same rows.  The native draws stay available (``method="native"``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH_DIGITS = 8


def _as_text(df: DataFrame | None, c: str) -> Column:
    # floating columns go through a fixed-scale decimal so that every
    # engine renders the same text
    col = F.col(c)
    if df is not None and isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        col = col.cast("decimal(38,6)")
    return F.coalesce(col.cast("string"), F.lit("~"))


def hash_unit(cols: Sequence[str], seed: int, df: DataFrame | None = None) -> Column:
    """Deterministic pseudo-uniform value in [0, 1) per row:
    the first hex digits of md5(col1 | col2 | ... | seed)."""
    text = F.concat_ws("|", *[_as_text(df, c) for c in cols], F.lit(str(seed)))
    head = F.substring(F.md5(text), 1, HASH_DIGITS)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(16 ** HASH_DIGITS))


def hash_split(df: DataFrame, weights: Sequence[float], seed: int,
               cols: Sequence[str] | None = None) -> list[DataFrame]:
    """Split by cumulative weights on the row hash.  Rows with
    equal key columns always land in the same part."""
    cols = list(cols or df.columns)
    total = float(sum(weights))
    u = hash_unit(cols, seed, df)
    parts, lo = [], 0.0
    for i, w in enumerate(weights):
        hi = lo + w / total
        cond = (u >= lo) & (u < hi) if i < len(weights) - 1 else (u >= lo)
        parts.append(df.where(cond))
        lo = hi
    return parts


def random_split(df: DataFrame, weights: Sequence[float], seed: int,
                 method: str = "hash", cols: Sequence[str] | None = None) -> list[DataFrame]:
    if method == "native":
        return df.randomSplit(list(weights), seed)
    return hash_split(df, weights, seed, cols)


def bernoulli_sample(df: DataFrame, fraction: float, seed: int, method: str = "hash",
                     cols: Sequence[str] | None = None) -> DataFrame:
    """Sample without replacement."""
    if method == "native":
        return df.sample(False, fraction, seed)
    return df.where(hash_unit(list(cols or df.columns), seed, df) < fraction)


def rest_distinct(df: DataFrame, fraction: float, seed: int, cols: Sequence[str] | None = None) -> DataFrame:
    """U2 of a hash sample (``bernoulli_sample``): whether a row is in the
    sample depends on its columns only, so the EXCEPT DISTINCT is a filter on
    the same hash and one distinct, without reading the input twice."""
    return df.where(hash_unit(list(cols or df.columns), seed, df) >= fraction).distinct()


def except_distinct(df: DataFrame, other: DataFrame) -> DataFrame:
    """EXCEPT DISTINCT; every copy of a row present in ``other`` goes,
    duplicates collapse."""
    return df.subtract(other)


_SALTS = 32


def _least(label_col: str, per_label: int, order: Sequence[str]):
    """Of the rows that come in, the ``per_label`` first of each label."""
    def least(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in stream:
            rows = pa.Table.from_batches([batch])
            kept = rows if kept is None else pa.concat_tables([kept, rows])
            at = pc.sort_indices(kept, sort_keys=[(c, "ascending") for c in [label_col, "_u", *order]])
            label = kept[label_col].take(at).combine_chunks()
            n = len(label)
            differs = pc.fill_null(pc.not_equal(label.slice(1), label.slice(0, max(0, n - 1))), False).to_numpy(zero_copy_only=False)
            nulls = label.is_null().to_numpy(zero_copy_only=False)
            new = np.concatenate([[True], differs | (nulls[1:] != nulls[:-1])]) if n else np.empty(0, bool)
            place = np.arange(n)
            rank = place - np.maximum.accumulate(np.where(new, place, 0))
            kept = kept.take(at.take(pa.array(np.flatnonzero(rank < per_label))))
        if kept is not None:
            yield from kept.combine_chunks().to_batches()
    return least


def balanced_sample(df: DataFrame, label_col: str, per_label: int, seed: int,
                    cols: Sequence[str] | None = None) -> DataFrame:
    """The ``per_label`` rows of every label with the smallest row
    hash (ties by the row's columns): a bottom-k sketch per label.

    A sketch is the union's sketch of the sketches of its parts, so each task
    keeps one as its rows stream by, and sketches are merged in two steps, by
    label and salt and then by label.  The input is read once, no task holds
    more than ``per_label`` rows a label and a batch, and only sketches are
    shuffled.
    """
    cols = list(cols or df.columns)
    least = _least(label_col, per_label, cols)
    rows = df.withColumn("_u", hash_unit(cols, seed, df))
    sketch = rows.mapInArrow(least, rows.schema)
    salt = F.pmod(F.xxhash64("_u"), F.lit(_SALTS))
    for spread in ([F.col(f"`{label_col}`"), salt], [F.col(f"`{label_col}`")]):
        sketch = sketch.repartition(*spread).mapInArrow(least, rows.schema)
    return sketch.drop("_u")
