"""Toxicity scores from class-conditional Kneser-Ney language models.

Two word-bigram models, toxic and ordinary, are counted from labelled texts.
Counts are continuation counts (distinct words further left), so copies of a
text count once.  They are discounted; the freed mass of a bigram goes to the
class's words, and that of the words to a backoff distribution that both
classes share: how many documents of the whole corpus hold the word.  A class
has counts of its own only for expressions whose counts differ clearly between
the classes (``least_z`` standard errors and a ratio of ``least_ratio``).  All
others, rare ones above all, come from the shared counts and are as likely in
one class as in the other.

Log-likelihoods are compared per word, once over the whole text and once over
its most toxic ``span`` consecutive words, as a few words decide about a long
text.  A logistic curve of both, fitted on labelled rows that the models have
not seen, gives the score.

Bounds: ``max_rows`` labelled rows of each class at most are used (those with
the smallest hashes of doc_id; all of a smaller class), a quarter of them for
the curve, where each class weighs as much as among all labelled rows.  A model of more than ``max_ngrams`` words or
bigrams is an error; none is left out.  Hence the sample's ids and the model have fixed greatest
sizes and are broadcast.  The shared counts are taken over all documents.

Scale: the corpus counts are one partial aggregation over the words of all
documents; scoring is one pass without a shuffle, and filtering sends each text
to the workers once.  Tables of bounded size are stored in a fixed number of files,
however many tasks read the documents.

Defined cases: a null or empty text has ratio zero and gets the curve's value
there.  Rows repeating a doc_id are scored each, and as labelled rows count
each.  Rows with a null label or doc_id teach nothing; a null doc_id is
scored.  Without labelled rows of both classes every score is the share of
toxic ones (0 if there are none).  Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gitquarry.llm.common import alnum_words, batches, run_hashes, signed, stored, text_keys, texts, word_hashes

MAX_ROWS = 4000
MAX_NGRAMS = 1_000_000
LEAST_Z = 4.0
LEAST_RATIO = 2.7
SPAN = 10
THRESHOLD = 0.3
TRAINING_FILES = 8
_START = 0  # stands left of a text's first word


@dataclass
class Model:
    """Log ratios toxic / ordinary of seen bigrams, and of left words and words where the bigram is unseen."""

    bigrams: tuple[np.ndarray, np.ndarray]
    lefts: tuple[np.ndarray, np.ndarray]
    words: tuple[np.ndarray, np.ndarray]
    unseen: float
    curve: tuple[float, float, float]


def _pairs(lefts: np.ndarray, words: np.ndarray) -> np.ndarray:
    return run_hashes(np.stack([lefts, words], axis=1).reshape(-1), 2)[::2]


def _found(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in the table, and its value."""
    held, values = table
    if not len(held):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
    return held[at] == keys, values[at]


def _ratios(model: Model, some: list[bytes], span: int = SPAN) -> np.ndarray:
    """Log-likelihood ratio per word of each text, and of its most toxic ``span`` words."""
    out = np.zeros((len(some), 2))
    for k, text in enumerate(some):
        words = word_hashes(alnum_words(text))
        if not len(words):
            continue
        lefts = np.concatenate([np.array([_START], np.uint64), words[:-1]])
        seen, value = _found(model.bigrams, signed(_pairs(lefts, words)))
        known, word = _found(model.words, signed(words))
        left_known, left = _found(model.lefts, signed(lefts))
        value = np.where(seen, value, np.where(known, word, model.unseen) + np.where(left_known, left, 0.0))
        sums = np.concatenate([[0.0], np.cumsum(value)])
        n = min(span, len(words))
        out[k] = sums[-1] / len(words), (sums[n:] - sums[:-n]).max() / n
    return out


def _corpus_words(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(stream):
        found = [np.unique(word_hashes(alnum_words(t))) for t in texts(batch.column(0))]
        words, n = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(signed(words)), pa.array(n, pa.int64())], names=["word", "n"])


def _labelled_words(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(stream):
        for label, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            words = word_hashes(alnum_words(text))
            before = np.concatenate([np.array([_START, _START], np.uint64), words])
            lefts = before[1:-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(words), label, np.int32)), pa.array(signed(before[:-2])), pa.array(signed(lefts)),
                 pa.array(signed(words)), pa.array(signed(_pairs(lefts, words)) if len(words) else signed(words))],
                names=["label", "further", "left", "word", "pair"])


def _scored(model: Model):
    a, b, c = model.curve

    def scored(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            found = texts(batch.column(1))
            ratios = _ratios(model, found)
            score = 1 / (1 + np.exp(-np.clip(a + b * ratios[:, 0] + c * ratios[:, 1], -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(text_keys(found)), pa.array(score), pa.array(ratios[:, 0])],
                names=["doc_id", "text_key", "score", "ratio"])
    return scored


def _features(model: Model):
    def features(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            ratios = _ratios(model, texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ratios.tolist(), pa.list_(pa.float64()))], names=["label", "ratios"])
    return features


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(label, doc_id, text, part) of at most ``max_rows`` labelled rows of
    each class, whatever the other's size; a quarter of them has part 3."""
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(
        "doc_id IS NOT NULL AND label IN (0, 1)")
    rows = rows.withColumn("place", F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")))
    chosen = [rows.where(F.col("label") == label).orderBy("place", "doc_id").limit(max_rows) for label in (0, 1)]
    sample = chosen[0].unionByName(chosen[1]).withColumn("part", F.pmod("place", F.lit(4)))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return stored(source.join(F.broadcast(sample), "doc_id").select("label", "doc_id", "text", "part"), TRAINING_FILES)


def _arrays(df: DataFrame, key: str) -> tuple[np.ndarray, np.ndarray]:
    """A bounded table as arrays sorted by key."""
    rows = sorted((r[0], r[1]) for r in df.select(key, "ratio").collect())
    return np.array([k for k, _ in rows], np.int64), np.array([v for _, v in rows], np.float64)


def _counts(df: DataFrame, keys: list[str]) -> tuple[DataFrame, dict]:
    """Discounted share of each n-gram in each class, how far apart they are,
    and each class's total and discount."""
    of = lambda label: F.sum(F.when(F.col("label") == label, F.col("seen")).otherwise(0))
    both = df.groupBy(*keys).agg(of(1).alias("toxic"), of(0).alias("plain"))
    sums = both.agg(*[f(c).alias(f"{c}_{n}") for c in ("toxic", "plain") for n, f in (
        ("total", F.sum), ("once", lambda c: F.count_if(F.col(c) == 1)), ("twice", lambda c: F.count_if(F.col(c) == 2)))]).first().asDict()
    n, m = max(sums["toxic_total"] or 0, 1), max(sums["plain_total"] or 0, 1)
    discount = {c: sums[f"{c}_once"] / (sums[f"{c}_once"] + 2 * sums[f"{c}_twice"]) if sums[f"{c}_once"] else 0.5 for c in ("toxic", "plain")}
    share = (F.col("toxic") + F.col("plain")) / (n + m)
    z = (F.col("toxic") / n - F.col("plain") / m) / F.sqrt(share * (1 - share) * (1 / n + 1 / m) + 1e-300)
    ratio = F.log((F.col("toxic") + 0.5) / n / ((F.col("plain") + 0.5) / m))
    cut = {c: F.greatest(F.col(c) - discount[c], F.lit(0.0)) for c in discount}
    return both.select(*keys, cut["toxic"].alias("toxic"), cut["plain"].alias("plain"), F.abs(z).alias("z"),
                       F.abs(ratio).alias("ratio")), {"toxic": n, "plain": m}


def _clear(counts: DataFrame, keys: list[str], least_z: float, least_ratio: float, max_ngrams: int) -> DataFrame:
    """The n-grams for which the classes have counts of their own.  All of
    them are used; more than a worker should hold are an error."""
    clear = counts.where((F.col("z") >= least_z) & (F.col("ratio") >= math.log(least_ratio)))
    clear = stored(clear.select(*keys, "toxic", "plain"), 1)
    if (n := clear.count()) > max_ngrams:
        raise ValueError(f"{n} n-grams tell the classes apart, more than max_ngrams = {max_ngrams}: use fewer labelled rows or a larger least_z")
    return clear


def language_models(training: DataFrame, docs: DataFrame, text_col: str, least_z: float = LEAST_Z,
                    least_ratio: float = LEAST_RATIO, max_ngrams: int = MAX_NGRAMS) -> Model:
    """training: (label, text) with both classes; docs: the whole corpus."""
    triples = training.select("label", "text").mapInArrow(
        _labelled_words, "label int, further long, left long, word long, pair long").distinct()
    bigrams = stored(triples.groupBy("label", "left", "word", "pair").agg(F.count("*").alias("seen")))
    corpus = stored(docs.select(F.col(text_col).alias("text")).mapInArrow(_corpus_words, "word long, n long")
                    .groupBy("word").agg(F.sum("n").alias("n")))
    held = corpus.agg(F.sum("n")).first()[0] or 1
    counts, total = _counts(bigrams.groupBy("label", "word").agg(F.count("*").alias("seen")), ["word"])
    clear = _clear(counts, ["word"], least_z, least_ratio, max_ngrams)
    used = clear.agg(F.sum("toxic"), F.sum("plain")).first()
    rest = {c: max(1 - (used[i] or 0.0) / total[c], 1e-6) for i, c in enumerate(("toxic", "plain"))}
    pairs, _ = _counts(bigrams, ["left", "word", "pair"])
    clear_pairs = _clear(pairs, ["left", "word", "pair"], least_z, least_ratio, max_ngrams)
    # what each class gives a word: its own share, and the shared one
    needed = clear.select("word").union(clear_pairs.select("word")).distinct()
    share = F.coalesce("n", F.lit(0.5)) / held
    words = stored(needed.join(corpus, "word", "left").join(clear, "word", "left").select(
        "word", F.col("toxic").isNotNull().alias("own"),
        *[(F.coalesce(c, F.lit(0.0)) / total[c] + rest[c] * share).alias(f"{c}_word") for c in ("toxic", "plain")]), 1)
    word_ratios = _arrays(words.where("own").select("word", F.log(F.col("toxic_word") / F.col("plain_word")).alias("ratio")), "word")
    # and a bigram, whose left word is followed by clear bigrams
    of = lambda label: F.sum(F.when(F.col("label") == label, F.col("seen")).otherwise(0))
    sums = bigrams.join(clear_pairs.select("left").distinct(), "left").groupBy("left").agg(
        F.greatest(of(1), F.lit(1)).alias("toxic_total"), F.greatest(of(0), F.lit(1)).alias("plain_total"))
    cuts = clear_pairs.groupBy("left").agg(F.sum("toxic").alias("toxic_cut"), F.sum("plain").alias("plain_cut"))
    lefts = stored(sums.join(cuts, "left").select(
        "left", "toxic_total", "plain_total",
        *[F.greatest(1 - F.col(f"{c}_cut") / F.col(f"{c}_total"), F.lit(1e-3)).alias(f"{c}_rest") for c in ("toxic", "plain")]), 1)
    likely = [F.col(c) / F.col(f"{c}_total") + F.col(f"{c}_rest") * F.col(f"{c}_word") for c in ("toxic", "plain")]
    pair_ratios = _arrays(clear_pairs.join(lefts, "left").join(words, "word").select(
        "pair", F.log(likely[0] / likely[1]).alias("ratio")), "pair")
    left_ratios = _arrays(lefts.select("left", F.log(F.col("toxic_rest") / F.col("plain_rest")).alias("ratio")), "left")
    return Model(pair_ratios, left_ratios, word_ratios, math.log(rest["toxic"] / rest["plain"]), (0.0, 0.0, 0.0))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_rows: int = MAX_ROWS, least_z: float = LEAST_Z, least_ratio: float = LEAST_RATIO,
          max_ngrams: int = MAX_NGRAMS) -> Model:
    none = (np.empty(0, np.int64), np.empty(0))
    training = training_rows(docs, labels, max_rows, id_col, text_col, label_col)
    classes = {(r.label, r.curve): r.n for r in training.groupBy("label", (F.col("part") == 3).alias("curve"))
               .agg(F.count("*").alias("n")).collect()}
    if not all(classes.get((label, curve)) for label in (0, 1) for curve in (False, True)):
        share = labels.where(F.col(label_col).isin(0, 1)).agg(F.avg(label_col)).first()[0] or 0.0
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Model(none, none, none, 0.0, (math.log(share / (1 - share)), 0.0, 0.0))
    model = language_models(training.where("part <> 3"), docs, text_col, least_z, least_ratio, max_ngrams)
    toxic = labels.where(F.col(label_col).isin(0, 1)).agg(F.avg(label_col)).first()[0]
    points = (training.where("part = 3").select("label", "text").mapInArrow(_features(model), "label int, ratios array<double>")
              .select(F.col("label").cast("double").alias("label"), array_to_vector("ratios").alias("features"),
                      F.when(F.col("label") == 1, F.lit(toxic / classes[1, True])).otherwise(F.lit((1 - toxic) / classes[0, True])).alias("weight")))
    fitted = LogisticRegression(maxIter=50, regParam=1e-3, weightCol="weight").fit(points)
    model.curve = (float(fitted.intercept), *map(float, fitted.coefficients))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, score, ratio (per word)."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_scored(model), f"doc_id {id_type}, text_key long, score double, ratio double")


def held_out(column: Column) -> Column:
    """Whether a row of this doc_id is kept from training."""
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def keep_below(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below the threshold."""
    a, b, c = model.curve
    rows = docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"))
    names = docs.columns
    at = names.index(text_col) if text_col in names else [name.lower() for name in names].index(text_col.lower())

    def below(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            ratios = _ratios(model, texts(batch.column(0).field(at)))
            score = 1 / (1 + np.exp(-np.clip(a + b * ratios[:, 0] + c * ratios[:, 1], -500, 500)))
            yield batch.filter(pa.array(score < threshold))
    return rows.mapInArrow(below, T.StructType([rows.schema["row"]])).select("row.*")
