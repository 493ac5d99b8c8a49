from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import pytest

from ledgerline.llm import toxicity as t


def plain(texts, gate, error_share):
    """Word evidence of (text, label) with plain counters."""
    own, pairs = {0: Counter(), 1: Counter()}, set()
    for text, label in texts:
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        own[label].update(words)
        pairs.update(zip(words, words[1:], strict=False))
    follows = Counter(b for _, b in pairs)
    vocabulary = set(own[0]) | set(own[1])

    def log_p(c, w):
        n1, n2 = sum(v == 1 for v in own[c].values()), sum(v == 2 for v in own[c].values())
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        shared = (follows[w] + 0.5) / (sum(follows.values()) + 0.5 * len(vocabulary))
        return math.log((max(own[c][w] - d, 0) + d * len(own[c]) * shared) / sum(own[c].values()))

    out = {}
    for w in vocabulary:
        r = log_p(1, w) - log_p(0, w)
        e = math.sqrt(1 / (own[1][w] + 0.5) + 1 / (own[0][w] + 0.5))
        if abs(r) > gate + error_share * e:
            out[w] = math.copysign(abs(r) - gate - error_share * e, r)
    return out


def corpus(n=600):
    r = random.Random(11)
    base, bad = [a + b for a in ("ka", "lo", "mi", "nu") for b in ("ra", "se", "ti", "vo")], ["vile", "rotten", "nasty"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = r.choices(base, k=r.randrange(20, 120))
        if toxic:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(bad)
        docs.append((i, " ".join(words).capitalize() + ".", "s"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


@pytest.mark.parametrize("gate", [0.0, 0.4])
def test_word_evidence_equals_plain(spark, gate):
    docs, labels = corpus(80)
    texts = [(d[1], lab[2]) for d, lab in zip(docs, labels, strict=True)] + [("", 0), ("word", 1), ("12 34", 1)]
    found = t.log_ratios(t.word_counts(spark.createDataFrame(texts, "text string, label int").repartition(3)), gate, 0.1).collect()
    keys = t.WordKeys()
    want = {keys[w]: v for w, v in plain(texts, gate, 0.1).items()}
    assert {r["word"] for r in found} == set(want)
    assert all(r["ratio"] == pytest.approx(want[r["word"]]) for r in found)


def test_held_out_rows(spark):
    docs, labels = corpus()
    docs += [(9000, None, "s"), (9001, "", "s"), (None, "Kara vile.", "s"), (3, docs[3][1], "s"), (9002, "vile " * 30_000, "s")]
    got = t.score_toxicity(spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels + [(None, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held) >= 0.97 * len(held)
    by = {r["doc_id"]: r for r in got}
    assert by[9000]["score"] == by[9001]["score"] < 0.3 < by[9002]["score"]


def test_held_out_labels_are_not_learned(spark):
    docs, labels = corpus(200)
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    flipped = [(i, q, 1 - x if zlib.crc32(str(i).encode()) % 4 == 2 else x) for i, q, x in labels]
    a, b = ({r["doc_id"]: r["score"] for r in t.score_toxicity(d, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (labels, flipped))
    assert a == b


def test_one_class_no_labels_no_rows(spark):
    docs, labels = corpus(40)
    d, lab = spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert len({r["score"] for r in t.score_toxicity(d, lab.where("toxic = 0")).collect()}) == 1
    assert {r["score"] for r in t.score_toxicity(d, lab.limit(0)).collect()} == {0.5}
    assert t.score_toxicity(d.limit(0), lab).count() == 0


def test_words_are_counted_on_rows_beyond_the_bound_of_the_curve(spark):
    docs, labels = corpus(200)
    d, lab = spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    all_rows, few = ({r["doc_id"]: r["evidence"] for r in t.score_toxicity(d, lab, n).collect()} for n in (t.FIT_ROWS, 5))
    assert any(all_rows.values()) and all(few[i] == pytest.approx(v) for i, v in all_rows.items())


def test_evidence_joins_any_number_of_words_by_key(spark):
    keys = t.WordKeys()
    docs = [(1, "vile vile day"), (2, None), (3, ""), (None, "vile"), (None, "vile"), (4, "calm day")]
    rows = spark.createDataFrame([(i, n, 0, x or "") for n, (i, x) in enumerate(docs)], "doc_id long, text_hash long, fold long, text string")
    ratios = spark.createDataFrame([(keys["vile"], 3.0), (keys["calm"], -1.0), *((k, 9.0) for k in range(1000))], "word long, ratio double")
    got = {r["text_hash"]: r["evidence"] for r in t.evidence(rows, ratios).collect()}
    assert got == {0: 2.0, 1: 0.0, 2: 0.0, 3: 3.0, 4: 3.0, 5: -0.5}


def test_frequent_words_are_weighed_like_others(spark, monkeypatch):
    docs, labels = corpus(200)
    docs += [(900, None, "s"), (901, "", "s"), (902, "vile " * 5000, "s")]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = []
    for most in (t.FREQUENT_WORDS, 3, 0):  # all words, some and none are broadcast
        monkeypatch.setattr(t, "FREQUENT_WORDS", most)
        found.append({r["doc_id"]: r["evidence"] for r in t.score_toxicity(d, lab).collect()})
    assert any(found[0].values()) and len(found[0]) == len(docs)
    assert all(other[i] == pytest.approx(v) for other in found[1:] for i, v in found[0].items())


def test_labelled_texts_meet_by_the_same_join_at_every_size(spark, monkeypatch, capsys):
    plans, count = [], t.word_counts
    monkeypatch.setattr(t, "word_counts", lambda texts: plans.append(texts) or count(texts))
    docs = spark.createDataFrame([(i, f"word{i % 7} text of row {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert t.score_toxicity(docs, labels).count() == 40
    plans[0].explain()
    joins = [line for line in capsys.readouterr().out.splitlines() if "Join [doc_id" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
