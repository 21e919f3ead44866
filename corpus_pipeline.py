"""From raw documents to packed training sequences.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written and read again as the next one's
docs.  All but the last return the columns of ``documents``.  ``run`` applies
them to the documents of a folder.

Defined cases, alike in all stages: a null text counts as empty; a row with a null
doc_id is judged like any other; rows that repeat doc_id and text share
their fate; further columns, whatever their names, are carried by all stages but the
last; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gitquarry.llm import decontaminate, exact_dedup, packing, simhash, toxicity
from gitquarry.llm.common import stored, table
from gitquarry.llm.queries import VOCABULARY

#: A trained scorer, fingerprints with connected groups and a tokeniser are in the chain: no SQL.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; the scorer
    learns from the labelled rows that are not held out.  An empty text is
    scored by the share of toxic labels alone, so it stays; without labels of
    both kinds every row has that score."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    return toxicity.keep_below(docs, toxicity.train(docs, labels), toxicity.THRESHOLD)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id; null only where all are null."""
    return exact_dedup.keep_one(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints the smallest doc_id.  Texts without words share one fingerprint."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; an empty text holds none."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; an empty text is a piece of the end id."""
    return packing.pack(docs, VOCABULARY)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
