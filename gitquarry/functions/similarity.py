"""String similarity.

Everything except Jaro-Winkler is a native expression.  Jaro-Winkler has
no built-in, so it runs as an Arrow-batched pandas UDF over the two string
columns; numpy works on one position of the shorter strings of a whole batch
at a time.  All measures give the same for (a, b) and (b, a), so
``identity.pair_dictionary`` computes them once per unordered pair of strings.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ------------------------------------------------------------ F6 / F8
def max_length(a, b) -> Column:
    """the larger of the two lengths."""
    return F.greatest(F.length(_c(a)), F.length(_c(b)))


def edit_ratio(a, b) -> Column:
    """F8: (max_len - levenshtein) / max_len, unrounded; null for two
    empty strings."""
    m = max_length(a, b)
    return F.try_divide((m - F.levenshtein(_c(a), _c(b))).cast("double"), m.cast("double"))


# ------------------------------------------------------------ D4 / F12
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_counts(s) -> Column:
    """How often each of a-z occurs in ``s``, as 26 numbers."""
    c = _c(s)
    return F.transform(F.array(*map(F.lit, LETTERS)), lambda x: F.length(c) - F.length(F.replace(c, x)))


def other_counts(s) -> Column:
    """How often each character outside a-z occurs in ``s``, as a map."""
    chars = F.array_remove(F.split(F.translate(_c(s), LETTERS, ""), ""), "")
    return F.map_from_entries(F.transform(F.array_distinct(chars), lambda c: F.struct(
        c, F.size(F.filter(chars, lambda x: x == c)))))


def common_letters(letters_a, others_a, letters_b, others_b) -> Column:
    """D4 on counts: size of the multiset intersection of the characters."""
    la, oa, lb, ob = map(_c, (letters_a, others_a, letters_b, others_b))
    in_both = F.aggregate(F.zip_with(la, lb, lambda x, y: F.least(x, y)), F.lit(0), lambda n, c: n + c)
    return F.aggregate(F.map_keys(oa), in_both, lambda n, c: n + F.least(oa[c], F.coalesce(ob[c], F.lit(0))))


def intersect_len(a, b) -> Column:
    """Size of the multiset intersection of the characters of a and b.
    Where strings recur, count their letters once (``letter_counts``,
    ``other_counts``) and use ``common_letters``."""
    return F.when(_c(a).isNull() | _c(b).isNull(), F.lit(None).cast("int")) \
        .otherwise(common_letters(letter_counts(a), other_counts(a), letter_counts(b), other_counts(b)))


def round_half_up_ratio(k: Column, n: Column) -> Column:
    """k / n rounded half-up to two decimals with integer arithmetic (the
    reference formats to two decimals as text and parses back); null when
    n is 0."""
    num = F.lit(200) * k.cast("bigint") + n.cast("bigint")
    den = F.lit(2) * n.cast("bigint")
    # floor((200k + n) / 2n) is half-up of 100k/n for n > 0
    return F.when(n == 0, F.lit(None).cast("double")) \
        .otherwise(F.floor(num / den).cast("double") / F.lit(100.0))


def multiset_jaccard(a, b, rounded: bool = False, common: Column | None = None) -> Column:
    """k / (len a + len b - k) with k the multiset intersection size
    (``common``, if it is known); ``rounded`` applies two-decimal half-up
    rounding."""
    k = common if common is not None else intersect_len(a, b)
    n = F.length(_c(a)) + F.length(_c(b)) - k
    if rounded:
        return round_half_up_ratio(k, n)
    return F.try_divide(k.cast("double"), n.cast("double"))


# ------------------------------------------------------------ F10
def name_order_rules(p, f, l, p1, f1, l1) -> dict[str, Column]:
    """the seven concatenation rules c1-c7 (left P,F,L; right P1,F1,L1)."""
    p, f, l, p1, f1, l1 = map(_c, (p, f, l, p1, f1, l1))
    return {
        "c1": p1 == F.concat(f, l),
        "c2": p == F.concat(f1, l1),
        "c3": p1 == F.concat(l, f),
        "c4": p == F.concat(l1, f1),
        "c5": F.concat(l1, f1) == F.concat(l, f),
        "c6": F.concat(l1, f1) == F.concat(f, l),
        "c7": F.concat(l, f) == F.concat(f1, l1),
    }


# ------------------------------------------------------------ F13 / D5
def _jaro_parts(first: str, second: str):
    """Matches, half transpositions (integer), common prefix, max length.

    The shorter string is scanned; each of its characters takes the first
    unflagged equal character of the longer one inside the window
    ``max(len(longer) // 2 - 1, 0)``."""
    if len(first) > len(second):
        longer, shorter = first, second
    else:
        longer, shorter = second, first
    n_long = len(longer)
    rng = max(n_long // 2 - 1, 0)
    flags = bytearray(n_long)
    matched = []
    for i, ch in enumerate(shorter):
        lo = i - rng if i > rng else 0
        hi = min(i + rng + 1, n_long)
        j = longer.find(ch, lo, hi)
        while j != -1 and flags[j]:
            j = longer.find(ch, j + 1, hi)
        if j != -1:
            flags[j] = 1
            matched.append(ch)
    trans = 0
    k = 0
    for j in range(n_long):
        if flags[j]:
            if longer[j] != matched[k]:
                trans += 1
            k += 1
    prefix = 0
    for x, y in zip(first, second):
        if x != y:
            break
        prefix += 1
    return len(matched), trans // 2, prefix, n_long


def jaro_winkler_lang3(first: str, second: str) -> float:
    """Jaro-Winkler as the JVM string library computes it: boost when
    jaro >= 0.7 by min(0.1, 1/max_len) * prefix * (1 - jaro) with an
    uncapped prefix, then rounded to two decimals."""
    m, t, prefix, longest = _jaro_parts(first, second)
    if m == 0:
        return 0.0
    md = float(m)
    j = (md / len(first) + md / len(second) + (md - t) / md) / 3
    jw = j if j < 0.7 else j + min(0.1, 1.0 / longest) * prefix * (1.0 - j)
    return math.floor(jw * 100.0 + 0.5) / 100.0


def jaro_winkler_standard(first: str, second: str) -> float:
    """Textbook Jaro-Winkler: prefix capped at 4, scale 0.1, boost when
    jaro > 0.7, unrounded."""
    m, t, prefix, _ = _jaro_parts(first, second)
    if m == 0:
        return 0.0
    md = float(m)
    j = (md / len(first) + md / len(second) + (md - t) / md) / 3
    return j + min(prefix, 4) * 0.1 * (1.0 - j) if j > 0.7 else j


_VARIANTS = {"lang3": jaro_winkler_lang3, "standard": jaro_winkler_standard}

# strings longer than this go through the scalar code
_VECTOR_MAX_LEN = 64


def _codes(strs: list, width: int) -> np.ndarray:
    """Code points of equal-width padded strings as a (rows, width) array."""
    return np.array(strs, dtype=f"<U{width}").view(np.uint32).reshape(len(strs), width)


def _jaro_parts_batch(ca: np.ndarray, cb: np.ndarray, la: np.ndarray, lb: np.ndarray):
    """Vectorised ``_jaro_parts`` over rows of code-point arrays with
    lengths ``la`` / ``lb``: the greedy match runs one position of the
    shorter string at a time across all rows."""
    n, width = ca.shape
    first_longer = la > lb
    lc = np.where(first_longer[:, None], ca, cb)
    sc = np.where(first_longer[:, None], cb, ca)
    n_long = np.where(first_longer, la, lb)
    n_short = np.where(first_longer, lb, la)
    pos = np.arange(width)
    rng = np.maximum(n_long // 2 - 1, 0)[:, None]
    in_long = pos < n_long[:, None]
    flags = np.zeros((n, width), dtype=bool)
    smatched = np.zeros((n, width), dtype=bool)
    rows_all = np.arange(n)
    for i in range(int(n_short.max(initial=0))):
        # window max(i - rng, 0) <= j < min(i + rng + 1, n_long)
        cand = (np.abs(pos - i) <= rng) & in_long & ~flags
        cand &= (lc == sc[:, i:i + 1]) & (i < n_short)[:, None]
        has = cand.any(axis=1)
        j = cand.argmax(axis=1)
        r = rows_all[has]
        flags[r, j[has]] = True
        smatched[r, i] = True
    m = smatched.sum(axis=1)
    ms1 = np.zeros((n, width), dtype=np.uint32)
    ms2 = np.zeros((n, width), dtype=np.uint32)
    rr, cc = np.nonzero(smatched)
    ms1[rr, (np.cumsum(smatched, axis=1) - 1)[rr, cc]] = sc[rr, cc]
    rr, cc = np.nonzero(flags)
    ms2[rr, (np.cumsum(flags, axis=1) - 1)[rr, cc]] = lc[rr, cc]
    trans = ((ms1 != ms2) & (pos < m[:, None])).sum(axis=1) // 2
    same = (lc == sc) & (pos < n_short[:, None])
    prefix = np.cumprod(same, axis=1).sum(axis=1)
    return m, trans, prefix, n_long


def _jw_batch(ca: np.ndarray, cb: np.ndarray, la: np.ndarray, lb: np.ndarray,
              variant: str) -> np.ndarray:
    """Jaro-Winkler for rows of non-null strings; same floating-point
    operations, in the same order, as the scalar functions."""
    m, t, prefix, n_long = _jaro_parts_batch(ca, cb, la, lb)
    md = m.astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        j = (md / la + md / lb + (md - t) / md) / 3
        if variant == "lang3":
            boost = j + np.minimum(0.1, 1.0 / n_long) * prefix * (1.0 - j)
            jw = np.where(j < 0.7, j, boost)
            jw = np.floor(jw * 100.0 + 0.5) / 100.0
        else:
            jw = np.where(j > 0.7, j + np.minimum(prefix, 4) * 0.1 * (1.0 - j), j)
    return np.where(m == 0, 0.0, jw)


def _jw_distinct(fa: list, fb: list, variant: str) -> np.ndarray:
    """Jaro-Winkler of non-null string lists without NUL characters."""
    out = np.empty(len(fa))
    fn = _VARIANTS[variant]
    ua, ub = np.array(fa), np.array(fb)
    la = np.strings.str_len(ua).astype(np.int64)
    lb = np.strings.str_len(ub).astype(np.int64)
    longest = np.maximum(la, lb)
    lo = -1
    for hi in (8, 16, 32, _VECTOR_MAX_LEN):
        sel = np.nonzero((longest > lo) & (longest <= hi))[0]
        if len(sel):
            width = max(int(longest[sel].max()), 1)
            out[sel] = _jw_batch(_codes(ua[sel].tolist(), width), _codes(ub[sel].tolist(), width),
                                 la[sel], lb[sel], variant)
        lo = hi
    for i in np.nonzero(longest > _VECTOR_MAX_LEN)[0]:
        out[i] = fn(fa[i], fb[i])
    return out


def jaro_winkler_many(a, b, variant: str = "lang3") -> np.ndarray:
    """Jaro-Winkler of two equal-length sequences of strings (None gives
    NaN).  Each distinct (a, b) pair of the batch is computed once (blocked
    pairs repeat strings heavily); rows are grouped by the length of the
    longer string, so a rare long name does not widen the work of a whole
    batch; very long strings (and batches holding NUL characters) use the
    scalar code."""
    va = np.asarray(a, dtype=object)
    vb = np.asarray(b, dtype=object)
    out = np.full(len(va), np.nan)
    idx = np.nonzero(~(pd.isna(va) | pd.isna(vb)))[0]
    if len(idx) == 0:
        return out
    fa, fb = va[idx].tolist(), vb[idx].tolist()
    if "\x00" in "".join(fa) or "\x00" in "".join(fb):
        # NUL characters defeat fixed-width arrays and C-string hashing
        fn = _VARIANTS[variant]
        out[idx] = [fn(x, y) for x, y in zip(fa, fb)]
        return out
    ca, ua = pd.factorize(va[idx])
    cb, ub = pd.factorize(vb[idx])
    pair_codes, _ = pd.factorize(ca.astype(np.int64) * max(len(ub), 1) + cb)
    _, first = np.unique(pair_codes, return_index=True)
    values = _jw_distinct(ua[ca[first]].tolist(), ub[cb[first]].tolist(), variant)
    out[idx] = values[pair_codes]
    return out


def _jw_series(variant: str):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(jaro_winkler_many(a.to_numpy(dtype=object), b.to_numpy(dtype=object),
                                           variant), dtype="float64")
    return run


_UDFS: dict[str, object] = {}


def jaro_winkler(a, b, variant: str = "lang3") -> Column:
    """Jaro-Winkler similarity of two string columns (null in, null
    out)."""
    if variant not in _UDFS:
        _UDFS[variant] = F.pandas_udf(_jw_series(variant), "double")
    return _UDFS[variant](_c(a), _c(b))
