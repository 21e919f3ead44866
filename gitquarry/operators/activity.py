"""C4: developer activity per period.

Counts per (period, actor) of mailing-list messages, issue comments,
commits and bug-fix commits, combined by full outer joins on
(``Date``, ``ID``).  A null actor forms its own group and never matches
across inputs, so it yields separate rows.

Plan shape: the inputs are put one under the other, each scanned once, and
counted by one aggregate with partial counts, so there is one shuffle and no
join.  The rows per flag value are unfolded from the counts of a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gitquarry.functions.text import BUGFIX_PATTERN, MONTH_FORMAT, is_bugfix, period

KEYS = ["Date", "ID"]


def count_per_period(df: DataFrame, ts_col: str, actor_col: str, out: str,
                     fmt: str = MONTH_FORMAT) -> DataFrame:
    """A1: rows per (period, actor)."""
    return df.groupBy(period(ts_col, fmt).alias("Date"), F.col(actor_col).alias("ID")) \
        .agg(F.count(F.lit(1)).alias(out))


def bugfix_counts(commits: DataFrame, fmt: str = MONTH_FORMAT,
                  pattern: str = BUGFIX_PATTERN, date_col: str = "committer_date",
                  actor_col: str = "committer_id") -> DataFrame:
    """A2: commits per (period, actor, bug-fix flag); up to three rows per
    period and actor (true, false, null)."""
    return commits.groupBy(
        period(date_col, fmt).alias("Date"), F.col(actor_col).alias("ID"),
        is_bugfix("message", pattern).alias("bugfix"),
    ).agg(F.count(F.lit(1)).alias("bug_fix"))


def developer_activity(messages: DataFrame, comments: DataFrame, commits: DataFrame,
                       fmt: str = MONTH_FORMAT, bugfix_only: bool = False,
                       pattern: str = BUGFIX_PATTERN) -> DataFrame:
    """Columns ``Date, ID, comments, messages, commits, bug_fix``.

    ``bugfix_only=False`` keeps the reference's behaviour: the per-flag
    counts are joined unfiltered, so a developer-period with fixes and
    other commits gives one row per flag value, ``commits`` repeated on
    each.  ``bugfix_only=True`` joins only the fix counts, one row per key.
    """
    def tagged(df: DataFrame, ts_col: str, actor_col: str, source: str, flag=None) -> DataFrame:
        return df.select(period(ts_col, fmt).alias("Date"), F.col(actor_col).alias("ID"), F.lit(source).alias("source"),
                         (F.lit(None).cast("boolean") if flag is None else flag).alias("flag"))

    rows = tagged(messages, "date", "from_id", "messages") \
        .unionByName(tagged(comments, "created_at", "author_id", "comments")) \
        .unionByName(tagged(commits, "committer_date", "committer_id", "commits", is_bugfix("message", pattern)))
    # a key with a null matches nothing: its rows stay apart by their source
    unmatched = F.when(F.col("Date").isNull() | F.col("ID").isNull(), F.col("source"))
    own = lambda source, cond=None: F.count_if((F.col("source") == source) & (F.lit(True) if cond is None else cond))
    flags = [F.col("flag"), ~F.col("flag"), F.col("flag").isNull()][:1 if bugfix_only else 3]
    counts = rows.groupBy(*KEYS, unmatched.alias("alone")).agg(
        *[F.nullif(own(c), F.lit(0)).alias(c) for c in ("comments", "messages", "commits")],
        F.filter(F.array(*[own("commits", f) for f in flags]), lambda n: n > 0).alias("fixes"))
    alone = F.col("alone").isNotNull() & F.col("commits").isNotNull()
    pair = lambda n, fixes: F.struct(n.alias("commits"), fixes.alias("bug_fix"))
    none = F.lit(None).cast("bigint")
    matched = F.when(F.size("fixes") == 0, F.array(pair(F.col("commits"), none))) \
        .otherwise(F.transform("fixes", lambda n: pair(F.col("commits"), n)))
    apart = F.concat(F.array(pair(F.col("commits"), none)), F.transform("fixes", lambda n: pair(none, n)))
    return counts.select(*KEYS, "comments", "messages", F.explode(F.when(alone, apart).otherwise(matched)).alias("c")) \
        .select(*KEYS, "comments", "messages", "c.commits", "c.bug_fix")
