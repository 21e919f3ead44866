"""Url filter by fixed host and path rules and by mined association rules.

Fixed rules come first: a rule fits its host and all subdomains if the url's
path starts with the rule's path, and the longest fitting rule decides.  Their
verdicts are the labels from which Spark's FP-growth mines combinations of url
tokens that go with ``block`` or ``allow``.  Mined rules are pruned by support,
by confidence, and where a rule over a part of their tokens is as confident;
there is no other cut, neither of their number nor of their length.  They match
other urls by an inverted index: each mined rule is listed under its rarest
token, urls look their tokens up, and the rest of the rule's tokens is checked.
The most confident mined rule decides (then support, then token order); a
url that none fits is allowed.

Tokens: scheme, host labels (with their distance from the right end), path
segments with digits made ``0``, file endings, names of query fields, and
whether there is a fragment.

Tokens that occur in exactly the same labelled urls are one item for the
mining: sets that differ in such tokens have the same counts, so of their rules
pruning leaves those with one token of the class.  A mined rule over a
class stands for these rules, one for each of its tokens.

Scale: FP-growth mines over all labelled urls in parallel.  How many sets
reach the support does not depend on the number of urls; tokens that always
go together, as the query fields of one site do, count as one.  Rules are pruned and
looked up by equi-joins, so neither they nor the index need fit one machine;
Spark broadcasts a small index by itself, and then urls are not shuffled for
it.  Matches are reduced per url.  Hosts are no key of any shuffle.

Defined cases: a null url, or one without ``://``, has empty host and path and
no tokens, so it is allowed.  Rows repeating a page_id are judged each; a null
page_id is carried.  If the fixed rules give less than two kinds of labels,
nothing is mined.  Further columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gitquarry.llm.common import stored

MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.8
_LABEL = "verdict="


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The stated rules.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))


def split_urls(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(page_id, url, host, path)"""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rest = F.coalesce(_after_scheme(F.col("url")), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return rows.select("page_id", "url", host.alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"))


def fixed_rule(rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits host and path, as a struct (rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the last that fits wins
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def tokens() -> Column:
    """The distinct tokens of a row's url, host and path."""
    labels = F.reverse(F.split("host", r"\."))
    plain = F.regexp_replace(F.lower("path"), "[0-9]+", "0")
    scheme = F.when(F.col("host") != "", F.array(F.concat(F.lit("scheme="), F.lower(F.expr("substring_index(url, '://', 1)")))))
    hosts = F.transform(labels, lambda x, i: F.concat(F.lit("host"), i.cast("string"), F.lit("="), x))
    segments = F.transform(F.filter(F.split(plain, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), x))
    ending = F.regexp_extract(plain, r"\.([a-z0]{1,5})$", 1)
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    fields = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("field="), F.lower(F.element_at(F.split(x, "="), 1))))
    fragment = F.when(F.instr("url", "#") > 0, F.array(F.lit("fragment")))
    none = F.array().cast("array<string>")
    found = F.concat(F.coalesce(scheme, none), hosts, segments,
                     F.when(ending != "", F.array(F.concat(F.lit("ending="), ending))).otherwise(none), fields, F.coalesce(fragment, none))
    return F.when(F.col("host") != "", F.array_distinct(found)).otherwise(none)


def equal_tokens(labelled: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """(token, item): ``item`` is the first of the tokens that occur in
    exactly the same rows of ``labelled`` (row, tokens), for tokens that reach the support.

    Two tokens occur in the same rows if their counts and two sums of hashes
    of the rows' ids (128 bits) are equal.  Tokens of one class stand together in one url, so
    a class is no longer than a url."""
    least = min_support * labelled.count()
    sums = [F.sum(F.xxhash64("row", F.lit(seed)).cast("decimal(38,0)")).alias(f"s{seed}") for seed in (1, 2)]
    listed = (labelled.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), *sums)
              .where(F.col("n") >= least))
    return (listed.groupBy("n", "s1", "s2").agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens"))
            .select(F.explode("tokens").alias("token"), "item"))


def _under_rarest(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """(token, mined): each rule under its rarest token; counts: (token, count)."""
    listed = (rules.withColumn("token", F.explode("tokens")).join(counts, "token")
              .groupBy("tokens", "verdict", "confidence", "support").agg(F.min(F.struct("count", "token")).alias("rarest")))
    return listed.select(F.col("rarest.token").alias("token"),
                         F.struct("confidence", "support", F.col("tokens").alias("body"), "verdict").alias("mined"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
         max_tokens: int | None = None, max_rules: int | None = None) -> DataFrame:
    """labelled: (tokens, verdict).  Rules (tokens, verdict, confidence,
    support).  A caller may ask for rules of ``max_tokens`` tokens at most, and
    for the ``max_rules`` most confident of those that pruning leaves."""
    items = labelled.select(F.array_append("tokens", F.concat(F.lit(_LABEL), F.col("verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    sets = model.freqItemsets.select(F.array_sort("items").alias("items"), "freq")
    sets = stored(sets if max_tokens is None else sets.where(F.size("items") <= max_tokens + 1))
    is_label = lambda x: x.startswith(_LABEL)
    bodies = sets.where(~F.exists("items", is_label)).select(F.col("items").alias("tokens"), F.col("freq").alias("all"))
    heads = sets.where(F.exists("items", is_label) & (F.size("items") > 1)).select(
        F.filter("items", lambda x: ~is_label(x)).alias("tokens"),
        F.substring(F.element_at(F.filter("items", is_label), 1), len(_LABEL) + 1, 100).alias("verdict"), "freq")
    total = items.count()
    rules = stored(heads.join(bodies, "tokens").select(
        "tokens", "verdict", (F.col("freq") / F.col("all")).alias("confidence"), (F.col("freq") / total).alias("support"))
        .where(F.col("confidence") >= min_confidence))
    # a rule says nothing that one over a part of its tokens doesn't say as surely: first parts of one token less ...
    parts = rules.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("part_confidence"))
    less = rules.withColumn("part", F.explode(F.transform("tokens", lambda x: F.array_remove("tokens", x))))
    weaker = less.join(parts, ["part", "verdict"]).where("part_confidence >= confidence").select("tokens", "verdict").distinct()
    rules = stored(rules.join(weaker, ["tokens", "verdict"], "left_anti"))
    # ... then of any size; what a pruned part covers, the part that covers it covers too
    counts = bodies.where(F.size("tokens") == 1).select(F.element_at("tokens", 1).alias("token"), F.col("all").alias("count"))
    weaker = (rules.withColumn("token", F.explode("tokens")).join(_under_rarest(rules, counts), "token")
              .where((F.col("verdict") == F.col("mined.verdict")) & (F.size("mined.body") < F.size("tokens"))
                     & (F.size(F.array_except("mined.body", "tokens")) == 0) & (F.col("mined.confidence") >= F.col("confidence")))
              .select("tokens", "verdict").distinct())
    rules = rules.join(weaker, ["tokens", "verdict"], "left_anti")
    return stored(rules if max_rules is None else rules.orderBy(
        F.desc("confidence"), F.desc("support"), "tokens", "verdict").limit(max_rules))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES,
          min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_tokens: int | None = None,
          max_rules: int | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule (the fixed
    rule's name or null), verdict, and tokens and confidence of the mined
    rule that decided."""
    rows = split_urls(pages, id_col, url_col).select("page_id", "url", "host", "path", fixed_rule(rules).alias("fixed"), tokens().alias("tokens"))
    labelled = rows.where("fixed IS NOT NULL").select("tokens", F.col("fixed.verdict").alias("verdict"))
    if labelled.select("verdict").distinct().count() < 2:
        return rows.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.verdict", F.lit("allow")).alias("verdict"),
                           F.lit(None).cast("array<string>").alias("mined_tokens"), F.lit(None).cast("double").alias("confidence"))
    # rows are told apart by an id that is fixed by storing them
    labelled = stored(labelled.withColumn("row", F.monotonically_increasing_id()))
    classes = stored(equal_tokens(labelled, min_support))
    classed = stored(labelled.select("row", "verdict", F.explode_outer("tokens").alias("token")).join(classes, "token", "left")
                     .groupBy("row", "verdict").agg(F.collect_set("item").alias("tokens")))
    mined = mine(classed.select("tokens", "verdict"), min_support, min_confidence, max_tokens, max_rules)
    # each mined rule stands in the index under its rarest token
    counts = classed.select(F.explode("tokens").alias("token")).groupBy("token").count()
    index = stored(_under_rarest(mined, counts))
    # any token of a class stands for the class; the last one that the url has is the rule's token
    open_rows = (rows.where("fixed IS NULL").select("page_id", "url", F.explode("tokens").alias("token")).join(classes, "token")
                 .groupBy("page_id", "url", "item").agg(F.max("token").alias("token"))
                 .groupBy("page_id", "url").agg(F.map_from_entries(F.collect_list(F.struct("item", "token"))).alias("own")))
    written = F.struct(F.col("mined.confidence").alias("confidence"), F.col("mined.support").alias("support"),
                       F.array_sort(F.transform("mined.body", lambda x: F.col("own")[x])).alias("body"), F.col("mined.verdict").alias("verdict"))
    best = (open_rows.select("*", F.explode(F.map_keys("own")).alias("token")).join(index, "token")
            .where(F.size(F.array_except("mined.body", F.map_keys("own"))) == 0)
            .groupBy("page_id", "url").agg(F.max(written).alias("best"))
            .select(F.col("page_id").alias("best_id"), F.col("url").alias("best_url"), "best"))
    same = rows["page_id"].eqNullSafe(best["best_id"]) & (rows["url"] == best["best_url"])
    return rows.join(best, same, "left").select(
        "page_id", "host", "path", F.col("fixed.rule").alias("rule"),
        F.coalesce("fixed.verdict", "best.verdict", F.lit("allow")).alias("verdict"),
        F.col("best.body").alias("mined_tokens"), F.col("best.confidence").alias("confidence"))
