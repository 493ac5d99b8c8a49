"""Licence scan over a positional index of rare licence words; DataFrame functions only.

Notices are indexed by the places of their telling words. One pass over the texts keeps the places of
those words and of the phrases below; the number of documents with a word gives its inverse
document frequency. Every telling word of a file is looked up in the index; entries that
agree on the relative position of file and notice are added up; a notice is labelled when enough of
its weight meets at one position and its mandatory phrase stands there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import text_hash, text_of
from ledgerline.session import materialize

# Phrases that are labelled wherever they stand.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Notices (label, mandatory phrase, text).
NOTICES = [
    ("mit", "under the mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache-2", "apache license version 2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-2", "gnu general public license version 2", "under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("gpl-3", "gnu general public license version 3", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "gnu affero general public license", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-2", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "creative commons attribution 4 0", "licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
]

# Words too common to look a notice up by.
COMMON = set("a all and any are as be by for in into is it may not of or that the this to under use with without you 0 2 3 4 v".split())

#: Words of a file that are looked up, the rarest first; None: all of them, so that a file may hold many notices.
LOOKED_UP = None
#: Share of a notice's weight that has to meet at one relative position.
MIN_WEIGHT = 0.3

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The word pattern before A-Z are lower-cased.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def telling(words: list[str]) -> list[tuple[str, int]]:
    """(word, place) of the words a notice is looked up by."""
    return [(w, i) for i, w in enumerate(words) if w not in COMMON]


POSTINGS = [(word, n, place) for n, (_, _, text) in enumerate(NOTICES) for word, place in telling(text.split())]
VOCABULARY = sorted({w for w, _, _ in POSTINGS} | {w for p in BASE for w in p.split() if w not in COMMON})
PHRASES = sorted({*BASE, *(phrase for _, phrase, _ in NOTICES)})


def _lowered(word: Column) -> Column:
    return F.translate(word, UPPER, LOWER)


def _phrase_places(words: Column, hits: Column, number: int) -> Column:
    """Starts of a phrase, found from the hits of its first telling word."""
    phrase = PHRASES[number].split()
    anchor, shift = telling(phrase)[0]
    starts = F.transform(F.filter(hits, lambda h: (h["word"] == anchor) & (h["place"] >= shift)), lambda h: h["place"] - shift)
    wanted = F.array(*(F.lit(w) for w in phrase))
    stands = F.filter(starts, lambda s: F.transform(F.slice(words, s + 1, F.lit(len(phrase))), _lowered) == wanted)
    return F.transform(stands, lambda s: F.struct(F.lit(number).alias("phrase"), s.alias("place")))


def places(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, hits, phrases) from one pass over the texts."""
    text = text_of(docs)
    words = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_hash(docs["text"]).alias("text_hash"), F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)).alias("words"))
    # lower() finds too much at most (it also folds letters beyond ASCII); the word kept is exact
    seen = F.transform("words", lambda w, i: F.when(F.lower(w).isin(VOCABULARY), F.struct(_lowered(w).alias("word"), i.alias("place"))))
    held = words.select("doc_id", "text_hash", "words", F.filter(seen, lambda h: h.isNotNull()).alias("hits"))
    phrases = F.when(F.size("hits") > 0, F.flatten(F.array(*(_phrase_places(F.col("words"), F.col("hits"), n) for n in range(len(PHRASES))))))
    return held.select("doc_id", "text_hash", F.size("words").cast("bigint").alias("n_words"), "hits", phrases.alias("phrases"))


def frequencies(found: DataFrame) -> dict[str, float]:
    """Inverse document frequency of every vocabulary word; the vocabulary is fixed and small."""
    n = found.count()
    counted = found.where(F.size("hits") > 0).select(F.explode(F.array_distinct("hits.word")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    df = {r["word"]: r["n"] for r in counted.where(F.col("word").isin(VOCABULARY)).collect()}
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1e-3 for w in VOCABULARY}


def aligned(found: DataFrame, idf: dict[str, float], spark: SparkSession) -> DataFrame:
    """(doc_id, text_hash, notice, weight) of notices whose mandatory phrase stands where their words meet.

    ``weight`` is the best share of the notice's weight at one relative position.
    """
    with_hits = found.where(F.size("phrases") > 0)
    looked_up = with_hits.select("doc_id", "text_hash", F.explode("hits").alias("hit"))
    full = {n: sum(idf[w] for w, m, _ in POSTINGS if m == n) for n in range(len(NOTICES))}
    index = spark.createDataFrame([(w, n, place, idf[w] / full[n]) for w, n, place in POSTINGS], "word string, notice int, at int, share double")
    entries = looked_up.select("doc_id", "text_hash", F.col("hit.word").alias("word"), F.col("hit.place").alias("place")).distinct().join(F.broadcast(index), "word")
    met = entries.groupBy("doc_id", "text_hash", "notice", (F.col("place") - F.col("at")).alias("shift")).agg(F.sum("share").alias("weight")).where(F.col("weight") >= MIN_WEIGHT)
    mandatory = [(n, PHRASES.index(phrase), _place_of(phrase, text)) for n, (_, phrase, text) in enumerate(NOTICES)]
    expected = spark.createDataFrame(mandatory, "notice int, phrase int, inside int")
    stands = with_hits.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.explode("phrases").alias("p")).select("_id", "_hash", F.col("p.phrase").alias("_phrase"), F.col("p.place").alias("_place")).distinct()
    verified = met.join(F.broadcast(expected), "notice").join(
        stands,
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")) & (F.col("phrase") == F.col("_phrase")) & (F.col("shift") + F.col("inside") == F.col("_place")),
        "left_semi",
    )
    return verified.groupBy("doc_id", "text_hash", "notice").agg(F.max("weight").alias("weight"))


def _place_of(phrase: str, text: str) -> int:
    words, wanted = text.split(), phrase.split()
    return next(i for i in range(len(words)) if words[i : i + len(wanted)] == wanted)


def scan(docs: DataFrame) -> DataFrame:
    """Licence phrases and labels of every row of ``docs``.

    Returns ``doc_id, text_hash, n_words, n_base, first_word, last_word, base_labels, labels, score``.
    A null text is empty; a row without any phrase has nulls for the places, empty labels and score 0.
    ``score`` is the largest share of a labelled notice's weight that meets at one position. Rows with
    equal id and text are one document and get equal results, a null id is scanned like others, other
    columns are ignored, no rows give no rows.
    """
    spark = docs.sparkSession
    found = materialize(places(docs), "licence_places")
    best = aligned(found, frequencies(found), spark)
    label = F.element_at(F.array(*(F.lit(name) for name, _, _ in NOTICES)), F.col("notice") + 1)
    per_doc = best.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set(label).alias("method"), F.max("weight").alias("weight"))
    base = F.filter(F.coalesce("phrases", F.array().cast("array<struct<phrase:int,place:int>>")), lambda p: p["phrase"].isin([PHRASES.index(b) for b in BASE]))
    names = F.array(*(F.lit(BASE.get(p)) for p in PHRASES))
    joined = found.withColumn("base", base).join(per_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    labels = F.array_sort(F.array_distinct(F.transform("base", lambda p: F.element_at(names, p["phrase"] + 1))))
    return joined.select(
        "doc_id",
        "text_hash",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min("base.place").cast("bigint").alias("first_word"),
        F.array_max("base.place").cast("bigint").alias("last_word"),
        F.array_join(labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, F.coalesce("method", F.array().cast("array<string>")))), ",").alias("labels"),
        F.least(F.lit(1.0), F.coalesce("weight", F.lit(0.0))).alias("score"),
    )
