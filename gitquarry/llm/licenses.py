"""Licence scan by diagonal voting.

Texts and templates are words (letters and digits, A-Z lower-cased).  All
rolling k-gram hashes of all texts are joined with the templates' k-gram
positions.  Each match votes for a diagonal, the distance between its place
in the text and in the template.  Votes are summed per diagonal, neighbouring
diagonals are merged (a word more or less shifts the rest by one), and every
merged span is then verified against the text's words: its coverage is the
share of template words that stand on one of its diagonals.

A phrase is a template that must be met whole on a single diagonal; where that
is so, the phrase's label is a base label.  Longer notices give labels of the
method's own from a coverage of ``least_coverage``.

Scale: the templates are a parameter of a fixed size (``MAX_TEMPLATE_GRAMS``),
checked and broadcast, so the k-grams of the corpus are not shuffled; matches
are aggregated per text, template and diagonal.  Texts then travel once,
compressed, to meet their spans.  The largest group is one text's matches
with one template.

Defined cases: a null or empty text has no words and no label.  Rows repeating
doc_id and text are one result row each with the same values; rows sharing a
doc_id with other texts are judged each; a null doc_id is carried.  Further
columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gitquarry.llm.common import alnum_words, batches, run_hashes, signed, stored, text_keys, texts, word_hashes

K = 3
SLACK = 2
LEAST_COVERAGE = 0.8
MAX_TEMPLATE_GRAMS = 100_000

# Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Wordings of public licence notices and their labels.
NOTICES = {
    "Released under the MIT License": "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction": "mit",
    "Licensed under the Apache License, Version 2.0": "apache-2",
    "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0": "apache-2",
    "This work is licensed under the GNU General Public License, version 3": "gpl-3",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation, either version 3 of the License": "gpl-3",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation; either version 2 of the License": "gpl-2",
    "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation": "lgpl",
    "Licensed under CC BY-NC 4.0": "cc-by-nc",
    "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc",
    "licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
    "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met": "bsd",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": "mpl-2",
}


def _template_rows(phrases: dict[str, str], notices: dict[str, str], k: int) -> tuple[list[tuple], list[tuple]]:
    """(template, label, base, words), and the places (hash, template, at) of their k-grams."""
    rows, places = [], []
    for base, wordings in ((True, phrases), (False, notices)):
        for wording, label in wordings.items():
            words = alnum_words(wording.encode())
            if len(words) < k:
                raise ValueError(f"a template needs {k} words: {wording}")
            places += [(h, len(rows), at) for at, h in enumerate(signed(run_hashes(word_hashes(words), k)).tolist())]
            rows.append((len(rows), label, base, words))
    if len(places) > MAX_TEMPLATE_GRAMS:
        raise ValueError(f"more than {MAX_TEMPLATE_GRAMS} template k-grams")
    return rows, places


def _grams(k: int):
    def grams(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, 64):
            found = texts(batch.column(1))
            runs = [signed(run_hashes(word_hashes(alnum_words(t)), k)) for t in found]
            ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*runs, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text_keys(found)), lists], names=["doc_id", "text_key", "grams"])
    return grams


def spans(docs: DataFrame, places: DataFrame, base: list[int], id_col: str, text_col: str, k: int, slack: int) -> DataFrame:
    """(doc_id, text_key, spans): merged diagonals (template, low, high, votes) of each text."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    grams = (source.mapInArrow(_grams(k), f"doc_id {id_type}, text_key long, grams array<long>")
             .select("doc_id", "text_key", F.posexplode("grams").alias("place", "hash")))
    matches = grams.join(F.broadcast(places), "hash")
    diagonals = (matches.groupBy("doc_id", "text_key", "template", (F.col("place") - F.col("at")).alias("diagonal"))
                 .agg(F.count("*").alias("votes")))
    order = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    apart = F.col("template").isin(base) | (F.col("diagonal") - F.lag("diagonal").over(order) > slack)
    merged = (diagonals.withColumn("new", F.coalesce(apart.cast("int"), F.lit(1)))
              .withColumn("span", F.sum("new").over(order))
              .groupBy("doc_id", "text_key", "template", "span")
              .agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.sum("votes").alias("votes")))
    return merged.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("template", "low", "high", "votes")).alias("spans"))


def _zipped(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd")
    for batch in batches(stream):
        found = texts(batch.column(1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(text_keys(found)), pa.array([len(t) for t in found], pa.int64()),
             pa.array([codec.compress(t, asbytes=True) for t in found], pa.binary())],
            names=["doc_id", "text_key", "size", "zipped"])


def coverage(words: list[bytes], template: list[bytes], low: int, high: int) -> float:
    """Share of the template's words that stand on a diagonal from low to high."""
    met = sum(any(0 <= at + d < len(words) and words[at + d] == word for d in range(low, high + 1))
              for at, word in enumerate(template))
    return met / len(template)


def _verified(templates: list[tuple], least: float):
    def verified(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches(stream):
            rows = []
            for doc_id, size, zipped, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "size", "zipped", "spans")), strict=True):
                words = alnum_words(codec.decompress(zipped, size, asbytes=True)) if size else []
                starts, base, own, best, kept = [], set(), set(), 0.0, []
                for s in found or ():
                    _, label, is_base, template = templates[s["template"]]
                    share = coverage(words, template, s["low"], s["high"])
                    if is_base and share == 1.0:
                        starts.append(s["low"])
                        base.add(label)
                    elif not is_base and share >= least:
                        own.add(label)
                        kept.append({"label": label, "start": max(0, s["low"]), "end": min(len(words), s["high"] + len(template)), "coverage": share})
                    if not is_base or share == 1.0:
                        best = max(best, share)
                rows.append({"doc_id": doc_id, "n_words": len(words), "n_base": len(starts),
                             "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                             "base_labels": sorted(base), "labels": sorted(base | own), "score": best,
                             "notices": sorted(kept, key=lambda x: (x["start"], x["label"], x["end"]))})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([
                ("doc_id", batch.column("doc_id").type), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())),
                ("score", pa.float64()), ("notices", pa.list_(pa.struct([
                    ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])))]))
    return verified


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None,
         notices: dict[str, str] | None = None, k: int = K, slack: int = SLACK, least_coverage: float = LEAST_COVERAGE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base (places of
    phrases), first_word and last_word (their smallest and largest start),
    base_labels, labels, score (best coverage) and notices (verified spans)."""
    templates, places = _template_rows(PHRASES if phrases is None else phrases, NOTICES if notices is None else notices, k)
    spark = docs.sparkSession
    held = spark.createDataFrame(places, "hash long, template int, at int")
    found = stored(spans(docs, held, [t[0] for t in templates if t[2]], id_col, text_col, k, slack))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    whole = source.mapInArrow(_zipped, f"doc_id {id_type}, text_key long, size long, zipped binary")
    found = found.select(F.col("doc_id").alias("span_id"), F.col("text_key").alias("span_key"), "spans")
    same = whole["doc_id"].eqNullSafe(found["span_id"]) & (whole["text_key"] == found["span_key"])
    return whole.join(found, same, "left").select("doc_id", "size", "zipped", "spans").mapInArrow(
        _verified(templates, least_coverage),
        f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
        "labels array<string>, score double, notices array<struct<label:string,start:long,end:long,coverage:double>>")
