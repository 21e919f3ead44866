"""Commits that induced the bugs later fixed.

For every bug-fixing commit the reference pairs each of its hunks with all
strictly earlier commits touching the same file, then, per fix commit,
keeps the latest earlier commit whose ``new_start`` lies at or below the
end of the changed region (``old_start + old_lines``; a one-sided test).
The region comes either from one anchor hunk per fix (``first_hunk``) or
from each hunk itself (``per_hunk``).

Semantics kept, with the order the reference leaves open made explicit:

* ``first_hunk``: the rows of a fix are ordered by (file_action_id,
  old_start, old_lines); the anchor is the first row whose old_start is not
  -1.  Rows ordered before it (all with old_start -1) are tested against
  their own region, all others against the anchor's, across every file of
  the fix.  Only rows with at least one earlier commit on their file take
  part (the group holds joined rows only).
* Dates compare strictly; among predecessors with the same latest date the
  lowest commit id wins.
* A fix with joined rows but no qualifying predecessor yields null, and
  that null stays in the distinct result.  A fix without any earlier
  commit on its files does not appear.

Plan: the predecessor side is reduced to one row per (file, commit) with
its minimum ``new_start`` (sufficient, as the test is one-sided); the fix
side to one query per (fix commit, file) with its widest bound.  The
search itself is ``dominance.latest_before_under``: no pairing of rows
within a file, and the winning commit's id comes with its date.  Building
the result starts no job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gitquarry.functions.text import BUGFIX_PATTERN, is_bugfix
from gitquarry.operators.dominance import latest_before_under, partitions, span_of

MATCH_MODES = ("first_hunk", "per_hunk")


def hunk_rows(commits: DataFrame, file_actions: DataFrame, hunks: DataFrame,
              pattern: str = BUGFIX_PATTERN) -> DataFrame:
    """commit x file_action x hunk, pruned to the columns the search needs,
    partitioned by the commit: what is grouped by the commit and more needs no
    other exchange."""
    c = commits.select(F.col("_id").alias("commit_id"), F.col("committer_date").alias("cdate"),
                       is_bugfix("message", pattern).alias("bugfix"))
    fa = file_actions.select(F.col("_id").alias("file_action_id"), "file_id", "commit_id")
    h = hunks.select("file_action_id", "new_start", "old_start", "old_lines")
    return h.join(fa, "file_action_id").repartition(partitions(h), "commit_id").join(c, "commit_id")


def _fix_queries(rows: DataFrame, first_date: DataFrame, match: str) -> DataFrame:
    """One query per (fix commit, file): its date and widest region end."""
    fixes = rows.where(F.col("bugfix") == F.lit(True)) \
        .select("commit_id", "cdate", "file_action_id", "file_id", "old_start", "old_lines") \
        .join(first_date, "file_id").where(F.col("cdate") > F.col("first_date"))
    own = F.col("old_start") + F.col("old_lines")
    if match == "per_hunk":
        bound = own
    else:
        key = F.struct("file_action_id", "old_start", "old_lines")
        fixes = fixes.repartition(partitions(fixes), "commit_id")
        # partial aggregate + join, not a window: no task holds the rows of a huge commit at once
        anchors = fixes.groupBy("commit_id") \
            .agg(F.min(F.when(F.col("old_start") != -1, key)).alias("anchor"))
        fixes = fixes.join(anchors, "commit_id")
        self_tested = F.col("anchor").isNull() | (key < F.col("anchor"))
        bound = F.when(self_tested, own).otherwise(
            F.col("anchor.old_start") + F.col("anchor.old_lines"))
    return fixes.groupBy("commit_id", "file_id", "cdate").agg(F.max(bound).alias("bound"))


def fix_to_inducing(commits: DataFrame, file_actions: DataFrame, hunks: DataFrame,
                    match: str = "first_hunk", pattern: str = BUGFIX_PATTERN) -> DataFrame:
    """One row per fix commit that has an earlier commit on one of its
    files: ``fix_commit_id, inducing_commit_id`` (null when none qualifies)."""
    if match not in MATCH_MODES:
        raise ValueError(f"match must be one of {MATCH_MODES}")
    rows = hunk_rows(commits, file_actions, hunks, pattern)
    preds = rows.groupBy("file_id", "commit_id", "cdate").agg(F.min("new_start").alias("m"))
    first_date = preds.groupBy("file_id").agg(F.min("cdate").alias("first_date"))
    queries = _fix_queries(rows, first_date, match)
    return latest_before_under(queries, preds, key=["file_id"], time_col="cdate", bound_col="bound", value_col="m",
                               id_col="commit_id", qid=["commit_id"], span=span_of(hunks, "new_start")) \
        .select(F.col("commit_id").alias("fix_commit_id"), F.col("latest_id").alias("inducing_commit_id"))


def bug_inducing(commits: DataFrame, file_actions: DataFrame, hunks: DataFrame,
                 match: str = "first_hunk", pattern: str = BUGFIX_PATTERN) -> DataFrame:
    """A4: distinct inducing commit ids (a null id survives as one row)."""
    return fix_to_inducing(commits, file_actions, hunks, match, pattern) \
        .select(F.col("inducing_commit_id").alias("commit_id")).distinct()


def count_inducing(inducing: DataFrame) -> DataFrame:
    """A5: total count of the distinct inducing ids."""
    return inducing.agg(F.count(F.lit(1)).alias("n_inducing"))
