from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import quality_model as q
from ledgerline.llm.quality_rules import WordHashes

TREE = """RandomForestClassificationModel: uid=x
  Tree 0 (weight 1.0):
    If (feature 0 <= 1.5)
     If (feature 1 <= 2.0)
      Predict: 0.0
     Else (feature 1 > 2.0)
      Predict: 1.0
    Else (feature 0 > 1.5)
     If (feature 0 <= 9.0)
      Predict: 0.0
     Else (feature 0 > 9.0)
      Predict: 1.0
"""
INF = float("inf")


def test_paths_are_conjunctions():
    a, b = q.STATISTICS[:2]
    assert q.paths_of(TREE) == {
        ((a, -INF, 1.5),), ((a, 1.5, INF),), ((a, -INF, 1.5), (b, -INF, 2.0)) if a < b else ((b, -INF, 2.0), (a, -INF, 1.5)),
        ((a, -INF, 1.5), (b, 2.0, INF)) if a < b else ((b, 2.0, INF), (a, -INF, 1.5)), ((a, 1.5, 9.0),), ((a, 9.0, INF),),
    }


def test_compiled_expression_equals_plain(spark):
    rules = [((("words", 1.0, INF),), 2.0), ((("digits", 0.2, 0.5), ("words", -INF, 3.0)), -1.5)]
    rows = [(w, d) for w in (0.0, 1.0, 2.0, 9.0) for d in (0.0, 0.2, 0.3, 0.9)]
    got = spark.createDataFrame(rows, "words double, digits double").select("words", "digits", q.compiled(0.25, rules).alias("s")).collect()
    for r in got:
        total = 0.25 + 2.0 * (r["words"] > 1) - 1.5 * (0.2 < r["digits"] <= 0.5 and r["words"] <= 3)
        assert r["s"] == pytest.approx(1 / (1 + math.exp(-total)))


def corpus(spark):
    r = random.Random(5)
    docs = [(i, " ".join(r.choices(["alpha", "beta", "gamma", "delta"], k=r.randrange(30, 90))) if i % 4 else "!! ".join(r.choices(["BUY", "NOW", "###"], k=60)), "s") for i in range(400)]
    docs += [(900, None, "s"), (901, "", "s"), (None, "alpha beta", "s"), (5, docs[5][1], "s")]
    labels = [(i, int(i % 4 != 0), 0) for i in range(400)] + [(None, 1, 0), (7, None, 0), (8, 0, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows_are_told_apart(spark):
    docs, labels = corpus(spark)
    got = q.score_quality(docs, labels).collect()
    assert len(got) == 404 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert sum(r["predicted"] == (r["doc_id"] % 4 != 0) for r in held) >= 0.98 * len(held)


def test_one_class_and_no_labels(spark):
    docs, labels = corpus(spark)
    only = {r["score"] for r in q.score_quality(docs, labels.where("quality = 1")).collect()}
    assert len(only) == 1 and only.pop() > 0.9
    assert {r["score"] for r in q.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert q.score_quality(docs.limit(0), labels).count() == 0


def test_statistics_of_odd_texts():
    for t in ("", " \n ", "one", "x" * 50_000, "é\n" * 1000):
        assert len(q.statistics(t, WordHashes())) == len(q.STATISTICS)


def test_sample_is_bounded(spark):
    df = spark.range(4000).withColumn("label", F.lit(1)).withColumnRenamed("id", "doc_id")
    assert 300 < q.bounded(df, 500).count() < 700
