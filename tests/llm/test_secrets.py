from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import secrets as s


def plain_candidates(text):
    out = []
    words = re.split(r"[\x20\x09-\x0D]+", text or "")
    for i, w in enumerate(words):
        for n, c in enumerate(re.findall("[A-Za-z0-9+/_-]{16,}", w)):
            if re.search("[0-9]", c) and re.search("[A-Za-z]", c) or re.search(s.ACCESS_KEY, c):
                out.append((i, n, c, " ".join([*([" ".join(words[max(0, i - 3) : i])]), w.split(c)[0]])))
    return out


def key(r):
    return "AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16))


def corpus(n=240):
    r = random.Random(6)
    words = [a + b for a in ("stone", "river", "cloud", "maple") for b in ("ford", "bank", "light", "wood")]
    docs, kinds = [], {}
    for i in range(n):
        parts = r.choices(words, k=60)
        digest = hashlib.sha1(str(i).encode()).hexdigest()
        kind = ("key", "password", "token", "commit", "slug", "none")[i % 6]
        at = {"key": key(r), "password": f"password={digest[:18]}", "token": f'token = "{digest}"', "commit": f"commit {digest}", "slug": f"{r.choice(words)}-{r.choice(words)}-{r.choice(words)}-2024", "none": ""}[kind]
        parts.insert(30, at)
        docs.append((i, " ".join(parts), "src1", 1.0))
        kinds[i] = kind
    return docs, kinds


def test_candidates_equal_plain(spark):
    docs, _ = corpus(60)
    docs += [(900, None, None, 1.0), (901, "", "x", 1.0), (902, " x=" + "a1" * 20 + "," + "b2" * 9 + "\n" + "1" * 30 + " " + "q" * 40, "p/tests/x", 1.0), (None, "ab12" * 20_000, "x", 1.0), (902, "none", "x", 1.0)]
    got = s.candidates(spark.createDataFrame(docs, "doc_id long, text string, source string, word double")).collect()
    want = sorted(((d, *c) for d, t, _, _ in docs for c in plain_candidates(t)), key=str)
    assert sorted(((r["doc_id"], r["word"], r["nth"], r["candidate"], r["before"]) for r in got), key=str) == want


def test_coverage_equals_plain(spark):
    entries = ["stone", "tone", "river", "aaaa"]
    cands = ["stoneriver123456789", "xx11yy22zz33ww44", "aaaaaa0000000000", "STONE-tone-123456"]
    got = {r["candidate"]: r["covered"] for r in s.covered(spark.createDataFrame([(c,) for c in cands * 2], "candidate string"), spark.createDataFrame([(e,) for e in entries], "entry string")).collect()}
    for c in cands:
        inside = {i + k for e in entries for i in range(len(c)) if c.lower()[i : i + len(e)] == e for k in range(len(e))}
        assert got[c] == pytest.approx(len(inside) / len(c))


def test_false_positives_go_and_secrets_stay(spark):
    docs, kinds = corpus()
    got = s.scan(spark.createDataFrame(docs, "doc_id long, text string, source string, score double")).collect()
    assert {r["doc_id"] for r in got} == {i for i, k in kinds.items() if k != "none"}
    right = sum(r["is_secret"] == (kinds[r["doc_id"]] in ("key", "password", "token")) for r in got)
    assert right >= 0.97 * len(got) and all(0 <= r["score"] <= 1 for r in got)


def test_given_findings_decide(spark):
    docs, kinds = corpus(60)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, score double")
    rule = s.labelled_findings(df, s.candidates(df))
    flipped = rule.withColumn("label", 1 - F.col("label"))
    got = s.scan(df, flipped).collect()
    assert sum(r["is_secret"] == (kinds[r["doc_id"]] in ("commit", "slug")) for r in got) >= 0.9 * len(got)
    assert {r["score"] for r in s.scan(df, rule.where("label = 0")).collect()} == {0.0}


def test_empty(spark):
    assert s.scan(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    assert s.scan(spark.createDataFrame([(1, "nothing here"), (None, None)], "doc_id long, text string")).count() == 0
