from __future__ import annotations

import math
import random
import re
from collections import Counter

import xxhash

from ledgerline.llm import quality_rules as q

SMOOTHING = 0.01  # the corpus here is tiny
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside)


def plain_ratio(docs, trusted):
    """Log ratio of each (id, text) with plain integers."""
    m64 = (1 << 64) - 1

    def buckets(text):
        h = [xxhash.xxh64_intdigest(w.encode()) for w in WORD.findall(text or "")]
        pairs = [(a * int(q._A) + b * int(q._B)) & m64 for a, b in zip(h, h[1:], strict=False)]
        return [((x * int(q._C)) & m64) >> 48 for x in h + pairs]

    raw, good = Counter(), Counter()
    for i, t in docs:
        raw.update(buckets(t))
        if i in trusted:
            good.update(buckets(t))
    n_raw, n_good, prior = sum(raw.values()), sum(good.values()), SMOOTHING * q.BUCKETS

    def ratio(b):
        corpus = (raw[b] + 0.5) / (n_raw + 0.5 * q.BUCKETS)
        return math.log((good[b] + prior * corpus) / (n_good + prior)) - math.log(corpus)

    return [sum(map(ratio, bs)) / len(bs) if (bs := buckets(t)) else 0.0 for _, t in docs]


def corpus():
    r = random.Random(3)
    good = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(r.choices(good, k=80))) for i in range(40)]
    docs += [(100 + i, "\n".join(" ".join(f"{r.choice(good).upper()}!!|" for _ in range(9)) for _ in range(8))) for i in range(10)]
    docs += [(200, None), (201, ""), (202, "one two"), (203, "a b c " * 40), (204, "x\ny\nx\n\n \n \nx"), (205, "ä b c d\x0be"), (None, docs[0][1]), (0, docs[0][1]), (206, "long " + "z" * 100_000)]
    return docs


def test_counts_ratio_and_verdict_equal_plain(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "kept", 1.0) for i, t in docs], "doc_id long, text string, kept string, log_ratio double")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(0, 1, 0), (None, 1, 0), (3, None, None), (100, 0, 0)], "doc_id long, quality int, toxic int")
    got = sorted(q.quality(df, labels, smoothing=SMOOTHING).collect(), key=lambda r: (str(r["doc_id"]), r["n_words"]))
    want = []
    for (i, t), ratio in zip(docs, plain_ratio(docs, set(range(20))), strict=True):
        c = plain_counts(t)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        want.append((i, *c, ratio, failed, not failed and ratio >= q.MIN_LOG_RATIO))
    want.sort(key=lambda w: (str(w[0]), w[1]))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g["doc_id"], g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"], g["base_failed"], g["kept"]) == (*w[:6], w[7], w[8])
        assert abs(g["log_ratio"] - w[6]) < 1e-9
    kept = {r["doc_id"] for r in q.keep_good(df, labels, SMOOTHING).collect()}
    assert kept == {w[0] for w in want if w[8]} and not kept & set(range(100, 206)) and kept >= set(range(40))


def test_every_trusted_document_is_counted(spark):
    labels = spark.range(60_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    ids = q.trusted_ids(labels.unionByName(labels.limit(10)).unionByName(spark.sql("select null doc_id, 1 quality, 0 toxic")))
    docs = spark.range(61_000).selectExpr("id as doc_id", "'a b' as text").unionByName(spark.sql("select null doc_id, 'n' text union all select 3, 'again'"))
    got = {(r["text"], r["is_trusted"]): r["count"] for r in q._marked(docs, ids).groupBy("text", "is_trusted").count().collect()}
    assert got == {("a b", True): 60_000, ("a b", False): 1000, ("n", False): 1, ("again", True): 1}


def test_keep_good_with_clashing_columns(spark):
    docs = spark.createDataFrame([(i, t, 1, "x", True) for i, t in corpus()], "doc_id long, text string, _id long, _hash string, is_trusted boolean")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    plainly = {r["doc_id"] for r in q.keep_good(docs.select("doc_id", "text"), labels, SMOOTHING).collect()}
    kept = q.keep_good(docs, labels, SMOOTHING)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == plainly >= set(range(40))


def test_empty(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.quality(docs, labels).count() == 0
    some = spark.createDataFrame([(1, "word " * 10)], "doc_id long, text string")
    assert q.quality(some, labels).first()["kept"] is False
