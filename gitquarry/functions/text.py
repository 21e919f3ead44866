"""Scalar string and date functions.

All are native Spark expressions, so they stay inside whole-stage codegen
and are pushed down where Catalyst can.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference for identical results:
# the bug-fix message pattern (case-insensitive, unanchored search), the
# period format of the activity report, and the prefix denylist.
BUGFIX_PATTERN = "(?i)fix(e[ds])?|bugs?|defects?|patch"
MONTH_FORMAT = "yyyy-MM"
PREFIX_DENYLIST = ("log", "list", "user")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_bugfix(message, pattern: str = BUGFIX_PATTERN) -> Column:
    """P10: unanchored regex search; null message gives null."""
    return _c(message).rlike(pattern)


def period(ts, fmt: str = MONTH_FORMAT) -> Column:
    """period bucket as text, in the session time zone."""
    return F.date_format(_c(ts), fmt)


def email_local_part(email) -> Column:
    """text before the first '@', the whole text when there is none."""
    return F.substring_index(_c(email), "@", 1)


def letters_only(s) -> Column:
    """drop everything outside A-Z / a-z (accented letters vanish)."""
    return F.regexp_replace(_c(s), "[^a-zA-Z]", "")


def first_name(name) -> Column:
    """First space-separated token; a leading space gives ''."""
    return F.substring_index(_c(name), " ", 1)


def last_name(name) -> Column:
    """Last space-separated token, ignoring trailing spaces (the JVM
    split drops trailing empty tokens).  A name of only spaces gives ''."""
    return F.substring_index(F.rtrim(_c(name)), " ", -1)


def concatenated(a, b, c) -> Column:
    """D3: three parts joined by single spaces."""
    return F.concat_ws(" ", _c(a), _c(b), _c(c))


def contains(a, b) -> Column:
    """Substring test."""
    return _c(a).contains(_c(b))


def not_denylisted(prefix, words=PREFIX_DENYLIST) -> Column:
    """The left prefix contains none of the denylisted words."""
    cond = F.lit(True)
    for w in words:
        cond = cond & ~_c(prefix).contains(w)
    return cond
