"""Latest earlier event under a threshold: an as-of join with a side
condition, computed without pairing events within a key.

For every query row ``q`` (key, t, b) find::

    max { p.t : p.key = q.key, p.t < q.t, p.m <= q.b }

over predecessor rows ``p`` (key, t, m, id), and of the predecessors of
that time the lowest id.  A range self-join would pair every query with
every earlier event of its key, which is quadratic in the size of a hot
key.  Instead:

* **Dyadic split of the threshold dimension.**  With ``u = m - lo`` and
  ``K`` bits covering the span of ``m``, a predecessor belongs to one node
  per level ``L`` (``u >> L``), and the prefix ``[0, b - lo]`` of a query
  is the disjoint union of at most ``K + 1`` nodes (one per set bit of
  ``y = x + 1``, node ``(y >> L) - 1``).  Within a node the threshold
  holds for every member, so only the time condition is left.
* **Prefix maximum over ranges of (key, level, node, time).**  All rows are
  range-partitioned in that order (Spark draws the range bounds from a
  sample of the rows, so a range holds about as many rows as any other,
  however the times and keys are spread) and sorted inside their range,
  queries before predecessors of equal time, higher ids before lower ones.
  One sweep over a range gives each query the last predecessor of its node
  (``_sweep``).  A group of equal (key, level, node) may cross ranges: then
  the queries at a range's start that no predecessor precedes there take the
  last predecessor of an earlier range, which each range hands on as one row.

Rows grow by ``K + 1`` per event (``K`` is the bit length of the span of
``m``, about 10-17 for line numbers).  No task holds more than its range and
the window that hands on maxima sees one row a range and run of open queries.
The span is a scalar subquery of the plan: building the result starts no job.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a row of a swept range is: an answered query, queries that an earlier range
#: may answer, or the last predecessor of the range's last group.
_ANSWERED, _OPEN, _LAST = 0, 1, 2


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions.  Given to an exchange it
    keeps adaptive execution from merging them: it merges by the compressed
    size, and short rows of numbers, sorted, take over ten times that in a task."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def span_of(df: DataFrame, value_col: str) -> Column:
    """(lo, hi) of a column as a scalar subquery."""
    return df.agg(F.struct(F.min(value_col).cast("bigint").alias("lo"), F.max(value_col).cast("bigint").alias("hi"))).scalar()


def time_key(col, dtype: T.DataType) -> F.Column:
    """A numeric key with the order of the time column, independent of the
    session time zone: microseconds for timestamps (for ``timestamp_ntz``
    from its calendar fields, since a cast through a zone with daylight
    saving is not monotone), days for dates, the value itself otherwise."""
    c = F.col(col) if isinstance(col, str) else col
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(dtype, T.TimestampNTZType):
        days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("bigint")
        whole = (days * 86400 + F.hour(c) * 3600 + F.minute(c) * 60).cast("bigint")
        micros = (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
        return whole * 1_000_000 + micros
    if isinstance(dtype, T.DateType):
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("bigint")
    return c


def _sweep(n_group: int):
    """Over the sorted rows (group columns, tk, is_q, id, query id columns)
    of one range."""
    def sweep(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        group, latest, first = None, None, True  # of the last row: its group, the group's last predecessor; the range's first group?
        for batch in stream:
            n = batch.num_rows
            if not n:
                continue
            keys, (tk, is_q, ids) = batch.columns[:n_group], batch.columns[n_group:n_group + 3]
            queries = pa.StructArray.from_arrays(batch.columns[n_group + 3:], names=batch.schema.names[n_group + 3:])

            def out(kind: int, rows: int, own, times, found, one, some) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [pa.array(np.full(rows, kind, np.int32)), pa.array(np.full(rows, part, np.int32)),
                     *(pa.nulls(rows, k.type) if own is None else pa.array([v] * rows, k.type) for k, v in zip(keys, own or keys, strict=True)),
                     pa.nulls(rows, tk.type) if times is None else times, pa.nulls(rows, ids.type) if found is None else found,
                     pa.nulls(rows, queries.type) if one is None else one,
                     pa.nulls(rows, pa.list_(queries.type)) if some is None else some],
                    names=["kind", "part", *batch.schema.names[:n_group], "tk", "id", "q", "qs"])

            new = np.zeros(n, bool)
            for k in keys:
                new[1:] |= pc.fill_null(pc.not_equal(k.slice(1), k.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
            own = tuple(k[0].as_py() for k in keys)
            new[0] = group is not None and own != group
            if new[0]:
                latest, first = None, False
            place = np.arange(n)
            asks = is_q.to_numpy(zero_copy_only=False)
            start = np.maximum.accumulate(np.where(new, place, -1))  # -1: the group goes on from an earlier batch
            before = np.maximum.accumulate(np.where(asks, -1, place))
            before[before < start] = -1
            inside = np.flatnonzero(asks & (before >= 0))
            if len(inside):
                at = pa.array(before[inside])
                yield out(_ANSWERED, len(inside), None, tk.take(at), ids.take(at), queries.take(pa.array(inside)), None)
            goes_on = np.flatnonzero(asks & (before < 0) & (start < 0))
            nowhere = np.flatnonzero(asks & (before < 0) & (start >= 0))
            if len(goes_on) and latest is None and first:
                some = pa.ListArray.from_arrays(pa.array([0, len(goes_on)], pa.int32()), queries.take(pa.array(goes_on)))
                yield out(_OPEN, 1, own, None, None, None, some)
            elif len(goes_on):
                rows = len(goes_on)
                times, found = (None, None) if latest is None else (pa.array([latest[0]] * rows, tk.type), pa.array([latest[1]] * rows, ids.type))
                yield out(_ANSWERED, rows, None, times, found, queries.take(pa.array(goes_on)), None)
            if len(nowhere):
                yield out(_ANSWERED, len(nowhere), None, None, None, queries.take(pa.array(nowhere)), None)
            if before[-1] >= 0:
                latest = tk[int(before[-1])].as_py(), ids[int(before[-1])].as_py()
            elif start[-1] >= 0:
                latest = None
            first = first and start[-1] < 0
            group = tuple(k[n - 1].as_py() for k in keys)
        if latest is not None:
            yield out(_LAST, 1, group, pa.array([latest[0]], tk.type), pa.array([latest[1]], ids.type), None, None)
    return sweep


def latest_before_under(queries: DataFrame, preds: DataFrame, key: Sequence[str], time_col: str,
                        bound_col: str, value_col: str, id_col: str, qid: Sequence[str],
                        span: Column) -> DataFrame:
    """One row per distinct ``qid`` of ``queries``: the query id columns,
    ``latest_key`` (the time as ``time_key``) and ``latest_id`` of the latest
    predecessor that any of its rows finds, lowest id first among equal
    times; both null where none is found.

    ``queries`` holds ``key``, ``qid``, ``time_col`` and ``bound_col``;
    ``preds`` holds ``key``, ``time_col``, ``value_col`` and ``id_col``.
    ``span`` is (lo, hi) of ``value_col`` (see ``span_of``; wider is fine).
    A null key, time or bound finds nothing; predecessors with a null are
    left out.
    """
    key, qid = list(key), list(qid)
    group = [f"k{i}" for i in range(len(key))] + ["lvl", "node"]
    keys = [F.col(c).alias(k) for c, k in zip(key, group)]
    tk = time_key(time_col, preds.schema[time_col].dataType).alias("tk")
    lo, levels = F.col("span.lo"), F.length(F.bin(F.col("span.hi") - F.col("span.lo")))
    no_qid = [F.lit(None).cast(queries.schema[c].dataType).alias(f"q_{c}") for c in qid]
    own_qid = [f"q_{c}" for c in qid]

    p = preds.dropna(subset=[*key, time_col, value_col]) \
        .select(*keys, tk, F.col(id_col).alias("id"), F.col(value_col).cast("bigint").alias("m"), span.alias("span")) \
        .select("*", (F.col("m") - lo).alias("u"), F.explode(F.sequence(F.lit(0), levels)).alias("lvl")) \
        .select(*group[:-1], F.expr("shiftright(u, lvl)").alias("node"), "tk", F.lit(False).alias("is_q"), "id", *no_qid)

    # a query without any node asks once for a node that no predecessor has, so that it is answered
    nodes = F.when(F.col("y") >= 1, F.expr("filter(sequence(0, k), l -> (shiftright(y, l) & 1) = 1)")).otherwise(F.array(F.lit(-1)))
    q = queries.select(*keys, tk, *[F.col(c).alias(f"q_{c}") for c in qid], F.col(bound_col).cast("bigint").alias("b"), span.alias("span")) \
        .withColumn("k", levels) \
        .withColumn("y", F.when(F.col("b").isNotNull(), F.least(F.col("b") - lo + 1, F.expr("shiftleft(1L, k)")))) \
        .select("*", F.explode(nodes).alias("lvl")) \
        .select(*group[:-1], F.when(F.col("lvl") < 0, F.lit(-1).cast("bigint")).otherwise(F.expr("shiftright(y, lvl)") - 1).alias("node"),
                "tk", F.lit(True).alias("is_q"), F.lit(None).cast(preds.schema[id_col].dataType).alias("id"), *own_qid)

    order = [*group, "tk", F.desc("is_q"), F.desc("id")]
    n = partitions(preds)
    rows = p.unionByName(q).repartitionByRange(n, *order).sortWithinPartitions(*order)
    types = {f.name: f.dataType for f in rows.schema.fields}
    one = T.StructType([T.StructField(c, types[c]) for c in own_qid])
    swept = rows.mapInArrow(_sweep(len(group)), T.StructType(
        [T.StructField("kind", T.IntegerType()), T.StructField("part", T.IntegerType()), *[T.StructField(g, types[g]) for g in group],
         T.StructField("tk", types["tk"]), T.StructField("id", types["id"]), T.StructField("q", one), T.StructField("qs", T.ArrayType(one))]))

    # answered queries have no group: they are spread by their id and see no other row
    spread = F.when(F.col("kind") == _ANSWERED, F.xxhash64("q"))
    swept = swept.withColumn("spread", spread).repartition(n, *group, "spread")
    earlier = Window.partitionBy(*group, "spread").orderBy("part", "kind").rowsBetween(Window.unboundedPreceding, -1)
    found = F.struct("tk", "id")
    handed_on = F.last(F.when(F.col("kind") == _LAST, found), ignorenulls=True).over(earlier)
    answers = swept.withColumn("found", F.when(F.col("kind") == _OPEN, handed_on).otherwise(found)).where(F.col("kind") != _LAST) \
        .select(F.explode(F.when(F.col("kind") == _OPEN, F.col("qs")).otherwise(F.array("q"))).alias("q"), "found")
    best = F.min(F.when(F.col("found.tk").isNotNull(), F.struct((-F.col("found.tk")).alias("before"), F.col("found.id").alias("id"))))
    return answers.groupBy(*[F.col(f"q.q_{c}").alias(c) for c in qid]).agg(best.alias("best")) \
        .select(*qid, (-F.col("best.before")).alias("latest_key"), F.col("best.id").alias("latest_id"))
