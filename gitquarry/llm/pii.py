"""Personal data by aggregated weak supervision; DataFrame functions only.

Candidate spans come from one pattern per kind: the base pattern (those that
pass its checks are the base spans, which always stay) and a wider one for
wordings that it misses.  Four labelers vote on every candidate, for, against
or not at all: regex (the base pattern and its checks), gazetteer (domain
endings, country codes, card issuers, reserved addresses), context (words
around the span) and shape.  Expectation-maximisation over the patterns of
votes estimates how reliable each labeler is and how probable each pattern
makes personal data.  With these probabilities as soft labels, a logistic
regression over features of the spans is trained, and it decides which
candidates are added to the base spans.

Scale: one pass over the texts, in which each row finds its own candidates,
without a shuffle; the patterns are linear in the text (possessive, and
anchored at the start of a run).  Only the candidates are stored.  Votes and
features have few values, so both are aggregated to tables of a fixed greatest
size before the models are fitted; votes are the only rows that the driver sees.

Defined cases: a null or empty text has no spans.  Rows repeating a doc_id are
returned each; a null doc_id is carried.  Further columns are ignored.  With
no candidates, or all of one kind of label, nothing is added to the base
spans.  An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gitquarry.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("regex", "gazetteer", "context", "shape")
THRESHOLD = 0.9
_ROUNDS = 50
#: Accuracies on what is not personal data and on what is that each labeler starts from, and as of how many spans.
_PRIOR = ((0.9, 0.8), (0.7, 0.7), (0.7, 0.7), (0.7, 0.7))
_PRIOR_SPANS = 4.0

# The base patterns, written so that a search is linear: a match starts at the start of a run of its
# first characters, or where the match before it ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

# Wider patterns for wordings that the base patterns miss.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]{1,63}+)++",
    "phone": r"(?<![0-9.()+-])(?<![0-9+]\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}

# What must be in a text for a pattern to match at all.
_NEEDED = {"email": "@", "phone": "+"}

# The gazetteers.
_DOMAINS = r"(?i)[.](com|org|net|edu|gov|info|io|de|fr|es|uk|eu|ch|at|it|nl)$"
_RESERVED = r"^(0|10|127|255|169\.254|192\.168|172\.(1[6-9]|2[0-9]|3[01])|22[4-9]|23[0-9])\."
_ISSUERS = r"^(4|5[1-5]|2[2-7]|3[4-7]|6)"
_COUNTRIES = r"^\+?(1|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"

# Words around a span.
_FOR = {
    "email": r"(?i)(mail|contact|write|reach|from|to)\b[^A-Za-z]{0,4}$",
    "ip": r"(?i)(\bip|address|host|login|logged|client|from)\b[^A-Za-z]{0,4}$",
    "card": r"(?i)(card|visa|master|amex|credit|payment|pay)\b[^A-Za-z]{0,4}$",
    "phone": r"(?i)(phone|call|tel|mobile|cell|fax|number|dial)\b[^A-Za-z]{0,4}$",
}
_AGAINST = r"(?i)(version|release|section|isbn|issn|order|serial|page|chapter|token|hash|=\s?\")[^A-Za-z]{0,4}$"

_SPAN = "array<struct<kind:string,wide:boolean,start:int,end:int,found:string,before:string,after:string>>"


def _spans_of(kind: str, pattern: str, wide: bool) -> Column:
    """All matches with their places (code points) and what is around them.
    The text is split at the matches, so that places are sums of lengths."""
    needed = _NEEDED.get(kind) if not wide else None
    text = F.col("text") if needed is None else F.when(F.contains("text", F.lit(needed)), F.col("text")).otherwise(F.lit(""))
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))

    def placed(p: Column) -> Column:
        steps = F.arrays_zip(p["m"].alias("m"), F.slice(p["g"], F.lit(1), F.size(p["m"])).alias("gap"),
                             F.slice(p["g"], F.lit(2), F.size(p["m"])).alias("next"))

        def step(a: Column, z: Column) -> Column:
            start = a["at"] + F.length(z["gap"])
            end = start + F.length(z["m"])
            span = F.struct(F.lit(kind).alias("kind"), F.lit(wide).alias("wide"), start.alias("start"), end.alias("end"), z["m"].alias("found"),
                            F.substring(z["gap"], -24, 24).alias("before"), F.substring(z["next"], 1, 8).alias("after"))
            return F.struct(end.alias("at"), F.concat(a["out"], F.array(span)).alias("out"))
        first = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
        return F.aggregate(steps, first, step, lambda a: a["out"])
    return F.element_at(F.transform(F.array(parts), placed), 1)  # a lambda binds the parts, so each is found once


def _valid(s: Column) -> Column:
    """Whether a match of a base pattern passes the kind's checks."""
    digits = F.regexp_replace(s["found"], "[^0-9]", "")
    parts = F.transform(F.split(s["found"], r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    small = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    return (F.when(s["wide"], F.lit(False)).when(s["kind"] == "email", F.lit(True)).when(s["kind"] == "ip", small)
            .when(s["kind"] == "card", F.length(digits).between(12, 19) & F.call_function("luhn_check", digits))
            .otherwise(F.length(digits).between(9, 15)))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))


def _judged(s: Column) -> Column:
    """A candidate with its votes and features, without its text."""
    found, digits = s["found"], F.regexp_replace(s["found"], "[^0-9]", "")
    n, size = F.length(digits), F.length(found)
    kind = lambda k: s["kind"] == k
    regex = F.when(s["wide"], F.lit(0)).otherwise(_vote(_valid(s), F.lit(True)))
    gazetteer = (F.when(kind("email"), _vote(found.rlike(_DOMAINS), F.lit(False)))
                 .when(kind("ip"), _vote(~found.rlike(_RESERVED), F.lit(True)))
                 .when(kind("card"), _vote(digits.rlike(_ISSUERS), F.lit(True)))
                 .otherwise(_vote(found.rlike(_COUNTRIES) & ~s["wide"], F.lit(False))))
    near = F.lit(False)
    for k, pattern in _FOR.items():
        near = near | (kind(k) & s["before"].rlike(pattern))
    context = _vote(near, s["before"].rlike(_AGAINST) | s["after"].rlike("^[\"A-Za-z_]"))
    shape = (F.when(kind("email"), _vote(size <= 254, F.lit(True)))
             .when(kind("ip"), _vote(~found.rlike(r"(^|\.)0[0-9]") & (size <= 15), F.lit(True)))
             .when(kind("card"), _vote(n.isin(13, 15, 16), F.lit(True)))
             .otherwise(_vote(n.between(10, 13), F.lit(True))))
    length = F.when(size < 8, 0).when(size < 12, 1).when(size < 16, 2).when(size < 20, 3).when(size < 40, 4).otherwise(5)
    number = F.when(n == 0, 0).when(n < 9, 1).when(n < 12, 2).when(n < 15, 3).when(n < 17, 4).otherwise(5)
    return F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _valid(s).alias("base"), s["wide"].alias("wide"),
        F.array(regex, gazetteer, context, shape).alias("votes"), length.alias("length"), number.alias("digits"),
        found.rlike(r"[\x20()-]").alias("parted"), s["before"].rlike(r"\s$").alias("apart"))


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, found): the judged candidates of each row, stored."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    every = [_spans_of(k, p, wide) for wide, patterns in ((False, BASE), (True, WIDE)) for k, p in patterns.items()]
    return stored(source.select("doc_id", F.transform(F.concat(*every), _judged).alias("found")))


def reliabilities(votes: list[tuple[str, list[int], int]]) -> dict:
    """Expectation-maximisation over (kind, votes, how often): each kind's
    share of personal data, and for each kind each labeler's accuracy on
    spans that are personal data and on those that are not."""
    kinds = sorted({k for k, _, _ in votes})
    share = {k: 0.5 for k in kinds}
    right = {k: [list(p) for p in _PRIOR] for k in kinds}  # on what is not, and on what is
    for _ in range(_ROUNDS):
        sums = {k: [1.0, 2.0] for k in kinds}
        hits = {k: [[[p * _PRIOR_SPANS, _PRIOR_SPANS] for p in labeler] for labeler in _PRIOR] for k in kinds}
        for kind, row, n in votes:
            p = posterior(kind, row, share, right)
            sums[kind][0] += n * p
            sums[kind][1] += n
            for j, vote in enumerate(row):
                if vote:
                    hits[kind][j][1][0] += n * p * (vote > 0)
                    hits[kind][j][1][1] += n * p
                    hits[kind][j][0][0] += n * (1 - p) * (vote < 0)
                    hits[kind][j][0][1] += n * (1 - p)
        share = {k: min(max(a / b, 0.01), 0.99) for k, (a, b) in sums.items()}
        right = {k: [[min(max(a / b, 0.05), 0.95) for a, b in h] for h in own] for k, own in hits.items()}
    return {"share": share, "right": right}


def posterior(kind: str, row: list[int], share: dict, right: dict) -> float:
    odds = math.log(share[kind] / (1 - share[kind]))
    for vote, (no, yes) in zip(row, right[kind], strict=True):
        odds += math.log(yes / (1 - no)) if vote > 0 else math.log((1 - yes) / no) if vote < 0 else 0.0
    return 1 / (1 + math.exp(-odds))


def _probability(s: Column, model: dict) -> Column:
    """The posterior as a column."""
    odds = F.lit(0.0)
    for kind, p in model["share"].items():
        own = F.lit(math.log(p / (1 - p)))
        for j, (no, yes) in enumerate(model["right"][kind]):
            vote = s["votes"][j]
            own = own + F.when(vote > 0, F.lit(math.log(yes / (1 - no)))).when(vote < 0, F.lit(math.log((1 - yes) / no))).otherwise(0.0)
        odds = odds + F.when(s["kind"] == kind, own).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def _features(s: Column) -> list[Column]:
    flags = [s["kind"] == k for k in KINDS] + [s["wide"], s["parted"], s["apart"]]
    flags += [s["length"] == i for i in range(6)] + [s["digits"] == i for i in range(6)]
    flags += [s["votes"][j] == v for j in range(len(LABELERS)) for v in (1, -1)]
    return [f.cast("double") for f in flags]


def _classifier(spans: DataFrame, model: dict) -> list[float] | None:
    """Intercept and weights of the span classifier, fitted to the posteriors."""
    s = F.col("s")
    rows = (spans.select(F.array(*_features(s)).alias("features"), _probability(s, model).alias("p"))
            .groupBy("features").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")))
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("yes").alias("weight")),
                             F.struct(F.lit(0.0).alias("label"), F.col("no").alias("weight"))))
    points = stored(rows.select("features", both.alias("x")).select("features", "x.label", "x.weight").where("weight > 0"))
    if points.select("label").distinct().count() < 2:
        return None
    fitted = LogisticRegression(maxIter=50, regParam=1e-3, weightCol="weight", standardization=False).fit(
        points.select(array_to_vector("features").alias("features"), "label", "weight"))
    return [float(fitted.intercept), *map(float, fitted.coefficients)]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and spans, arrays of (start,
    kind_no, kind, end) in that order; spans holds the base spans and what
    the classifier adds with a probability of ``threshold`` or more."""
    found = candidates(docs, id_col, text_col)
    spans = found.select(F.explode("found").alias("s"))
    votes = spans.groupBy("s.kind", "s.votes").count().collect()  # 4 kinds and 3 ** 4 votes at most
    weights = None
    if votes:
        weights = _classifier(spans, reliabilities([(r[0], list(r[1]), r[2]) for r in votes]))

    def placed(s: Column) -> Column:
        number = F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).cast("int")
        return F.struct(s["start"].alias("start"), number.alias("kind_no"), s["kind"].alias("kind"), s["end"].alias("end"))

    def added(s: Column) -> Column:
        if weights is None:
            return F.lit(False)
        odds = F.lit(weights[0])
        for w, x in zip(weights[1:], _features(s), strict=True):
            odds = odds + w * x
        free = ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        checked = s["votes"][0] >= 0  # the regex labeler votes against what fails its kind's checks
        return (1 / (1 + F.exp(-odds)) >= threshold) & ~s["base"] & checked & free
    base = F.array_sort(F.transform(F.filter("found", lambda s: s["base"]), placed))
    rows = found.select("doc_id", "found", base.alias("base"))
    more = F.transform(F.filter("found", added), placed)
    return rows.select("doc_id", "base", F.array_sort(F.array_distinct(F.concat("base", more))).alias("spans"))


def span_text(s: Column) -> Column:
    return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
