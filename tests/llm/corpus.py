"""Small tables with the cases that every operator must bear."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that operators use for columns of their own.
CLASHING = ["text_key", "kept", "keep_id", "fp", "score", "spans", "row", "doc", "hash", "n", "seq", "name", "found", "component_id"]
WORDS = "the of and to in is that for was on are with as his they at be this from have or by one had not but".split()


def words(seed: int, n: int, vocabulary: int = 400) -> list[str]:
    r = random.Random(seed)
    return [r.choice(WORDS) if r.random() < 0.3 else f"w{r.randrange(vocabulary)}" for _ in range(n)]


def texts(seed: int = 1, n: int = 60) -> list[str | None]:
    """Random texts with copies, near copies, shared passages, nulls, empty and very long ones."""
    r = random.Random(seed)
    passage = " ".join(words(seed + 999, 45))
    out: list[str | None] = [None, "", " \n\t ", "one", "two words", "été \U0001F600 naïve"]
    for i in range(n):
        w = words(seed * 1000 + i, r.randrange(3, 160))
        if r.random() < 0.3:
            at = r.randrange(len(w))
            w[at:at] = passage.split()
        out.append(" ".join(w))
    for _ in range(n // 3):
        x = r.choice(out[6:])
        out.append(r.choice([x, x.upper(), x.replace(" ", "\n", 3), x + " more", x.split(" ", 1)[-1]]))
    out.append(" ".join(words(seed + 5, 6000, 50)))
    out.append("again " * 300)
    out.append("x" * 50_000)
    return out


def documents(spark, found, clashing: bool = False, nulls: bool = True):
    """A documents table; the last row of the texts is listed twice, and one doc_id is null."""
    rows = [(i * 3 % 1009, t, "en", f"src{i % 3}", len(t) if t else None) for i, t in enumerate(found)]
    if nulls and rows:
        rows.append((None, found[len(found) // 2], None, None, None))
        rows.append(rows[-2])
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    if clashing:
        from pyspark.sql import functions as F
        df = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])
    return df, rows
