"""Helpers that the operators share: tables, stored intermediates, words."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from types import ModuleType
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gitquarry.session import checkpoint_dir

#: Rows of one Arrow batch that are worked on together: bounds the temporaries.
ROWS_AT_ONCE = 256

#: A-Z become a-z; what is neither a letter, a digit nor part of a non-ASCII character becomes a blank.
_ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

#: Odd multipliers of the hash of a run of words, one for each place in the run.
_PLACES = np.random.Generator(np.random.PCG64(20240501)).integers(1 << 62, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which the driver and all
    executors share.  It goes when the application's JVM ends."""
    root = checkpoint_dir(spark)
    if root is None:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{root.rstrip('/')}/gitquarry-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def stored(df: DataFrame, files: int | None = None) -> DataFrame:
    """Write ``df`` once as a table in a shared folder and read it from there:
    the lineage is cut, a lost executor costs a read only, and several
    readers share one computation.  ``files`` is for tables of bounded size
    that many tasks have a few rows of: the rows are first dealt to so many
    files at most.  (On a local folder without Hadoop's native library each
    file costs the executor several ``chmod`` processes.)"""
    path = f"{fresh_folder(df.sparkSession)}/table"
    df = df if files is None else df.repartition(files)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def worker_state(key: tuple, make: Callable[[], Any]) -> Any:
    """What ``make`` gave when a task of this Python worker first asked for
    ``key``: for bounded tables that are costly to fill and change no result."""
    kept = sys.modules.setdefault("gitquarry_worker_state", ModuleType("gitquarry_worker_state")).__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def batches(stream: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows`` at most."""
    for batch in stream:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_keys(found: list[bytes]) -> np.ndarray:
    """64-bit hashes that tell apart rows sharing a doc_id; as ``text_key``."""
    return np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in found), np.uint64, len(found)).view(np.int64)


def text_key(column: Column) -> Column:
    """The hash of ``text_keys`` as a column expression."""
    return F.xxhash64(F.coalesce(column, F.lit("")))


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose doc_id and text
    are among the rows (doc_id, text_key) of ``kept``."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(f"`{id_col}`").alias("row_id"), text_key(F.col(f"`{text_col}`")).alias("row_key"))
    keys = kept.select("doc_id", "text_key").distinct()
    same = rows["row_id"].eqNullSafe(keys["doc_id"]) & (rows["row_key"] == keys["text_key"])
    return rows.join(keys, same, "left_semi").select("row.*")


def alnum_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(_ALNUM).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words; empty if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out += hashes[i:i + n] * _PLACES[i]
    out ^= out >> np.uint64(32)
    out *= _PLACES[-1]
    out ^= out >> np.uint64(29)
    return out


def signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)
