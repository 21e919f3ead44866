"""Index maps of labels and features as tables (M3, M4).

The learners index labels by falling frequency and treat features of few
distinct values as categories.  Here both maps are DataFrames of their own, in the
order the learners use, so they can be stored, joined and checked.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_CATEGORIES = 10  # fixed value of the jobs


def label_index(df: DataFrame, label_col: str = "Label") -> DataFrame:
    """M3: ``label, n, index``; the most frequent label has index 0, equally
    frequent ones go by name.  Null labels have no index.  One row a label."""
    counts = df.where(F.col(label_col).isNotNull()).groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), F.asc("label"))) - 1
    return counts.select("label", "n", place.alias("index"))


def _few_values(most: int):
    """Up to ``most`` + 1 distinct values of each feature that a task sees."""
    def few(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, set] = {}
        for batch in stream:
            for name, column in zip(batch.schema.names, batch.columns, strict=True):
                own = seen.setdefault(name, set())
                if len(own) <= most:
                    for v in np.unique(column.drop_null().to_numpy(zero_copy_only=False)).tolist():
                        if len(own) > most:
                            break
                        own.add(v)
        pairs = [(name, v) for name, own in seen.items() for v in own]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.float64())],
                                         names=["feature", "value"])
    return few


def feature_index(df: DataFrame, features: Sequence[str], max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """M4: ``feature, value, index`` of the features with at most
    ``max_categories`` distinct values; the others have no rows.  Values are
    numbered in their order, but zero always has index 0 where it occurs.

    One pass over the rows for all features: a task stops to collect a
    feature's values beyond the limit, so what is shuffled is bounded by the number of
    tasks and features, not by the data.
    """
    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in features])
    found = numbers.mapInArrow(_few_values(max_categories), "feature string, value double").distinct()
    sets = found.groupBy("feature").agg(F.collect_set("value").alias("v")).where(F.size("v") <= max_categories)
    zero_first = F.sort_array(F.transform("v", lambda x: F.struct((x != 0).alias("nonzero"), x.alias("value"))))
    return sets.select("feature", F.posexplode(zero_first).alias("index", "e")).select("feature", "e.value", "index")
