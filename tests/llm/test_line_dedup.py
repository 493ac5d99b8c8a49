from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import line_dedup as ld


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(diagonal + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def near(a, b):
    n = min(len(a), len(b))
    if a == b or n < 10 or abs(len(a) - len(b)) > 2:
        return False
    k = len(os.path.commonprefix([a, b]))
    x, y = a[k:][::-1], b[k:][::-1]
    k = len(os.path.commonprefix([x, y]))
    return edits(x[k:], y[k:]) <= (1 if n < 20 else 2)


def mutated(r, s, letters="abcdeé "):
    s = list(s)
    for _ in range(r.randrange(0, 5)):
        at = r.randrange(len(s) + 1)
        kind = r.randrange(3)
        if kind == 0:
            s.insert(at, r.choice(letters))
        elif s and kind == 1:
            del s[min(at, len(s) - 1)]
        elif s:
            s[min(at, len(s) - 1)] = r.choice(letters)
    return "".join(s)


def line_set(seed, n=200):
    r = random.Random(seed)
    centres = ["".join(r.choices("abcdeé ", k=k)) for k in (3, 9, 10, 11, 19, 20, 21, 22, 40, 75, 300)] + ["a" * 30, "ab" * 12]
    out = set(centres)
    while len(out) < n:
        out.add(mutated(r, r.choice(centres)) if r.random() < 0.95 else "".join(r.choices("abc", k=r.randrange(1, 40))))
    return sorted(out)


def test_banded_distance_equals_table(spark):
    r = random.Random(4)
    pairs = [(a, mutated(r, a)) for _ in range(300) for a in ["".join(r.choices("abc", k=r.randrange(0, 25)))]] + [("", ""), ("", "ab"), ("abc", ""), ("a", "abcd"), ("ab", "ba")]
    df = spark.createDataFrame(pairs, "p string, t string")
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    got = df.select("p", "t", ld.banded_distance(chars("p"), chars("t")).alias("d")).collect()
    for x in got:
        want = edits(x["p"], x["t"])
        assert (x["d"] == want) if want <= 2 else x["d"] > 2, (x, want)


@pytest.mark.parametrize("group_rows", [1, 48])
def test_pairs_equal_brute_force(spark, monkeypatch, group_rows):
    monkeypatch.setattr(ld, "GROUP_ROWS", group_rows)
    lines = line_set(group_rows)
    got = {(r["a"], r["b"]) for r in ld.near_pairs(spark.createDataFrame(list(enumerate(lines)), "id long, line string")).collect()}
    want = {(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if near(lines[i], lines[j])}
    assert len(want) > 60 and got == want


def blank(line):
    return line.strip(" \t\x0b\x0c\r") == ""


def plain(docs):
    """Texts after dropping, and (lines, exact, near) per document."""
    order = sorted({(d, t or "") for d, t in docs}, key=lambda x: (x[0] is None, x[0] or 0))
    earlier, texts, counts = [], {}, {}
    for d, t in order:
        own, kept, n, exact, close = set(), [], 0, 0, 0
        before = set(earlier)
        for line in t.split("\n"):
            if blank(line):
                kept.append(line)
                continue
            if line in own:
                continue
            own.add(line)
            n += 1
            is_near = any(near(line, e) for e in earlier)
            if line in before:
                exact += 1
            elif is_near:
                close += 1
            else:
                kept.append(line)
            if line not in before:
                earlier.append(line)
        texts[d], counts[d] = "\n".join(kept), (n, exact, close)
    return texts, counts


def corpus():
    r = random.Random(8)
    pool = ["".join(r.choices("abcdefgh ", k=r.randrange(5, 60))) for _ in range(25)]
    docs = [(i, "\n".join(mutated(r, r.choice(pool), "xyz") if r.random() < 0.5 else r.choice([*pool, "", " \t"]) for _ in range(r.randrange(0, 9)))) for i in range(60)]
    return docs + [(None, "\n".join(pool[:3])), (70, None), (71, ""), (72, "\n\n"), (73, "z" * 70_000 + "\nshort"), (74, "z" * 70_001), (5, docs[5][1])]


def test_documents(spark):
    docs = corpus()
    df = spark.createDataFrame([(d, t, len(t or ""), "s") for d, t in docs], "doc_id long, text string, n_chars long, id string")
    texts, counts = plain(docs)
    got = ld.line_report(df).collect()
    assert len(got) == len(docs)
    assert {r["doc_id"]: (r["n_lines"], r["n_exact"], r["n_near"]) for r in got} == counts
    out = ld.dedup_lines(df).collect()
    assert len(out) == len(docs) and out[0].asDict().keys() == {"doc_id", "text", "n_chars", "id"}
    assert {r["doc_id"]: r["text"] for r in out if r["doc_id"] != 70} == {d: t for d, t in texts.items() if d != 70}
    assert [r["text"] for r in out if r["doc_id"] == 70] == [None]
    assert all(r["n_chars"] == len(r["text"]) for r in out if r["text"] is not None)


def test_clashing_columns(spark):
    docs = [(1, "first line of all\nsecond", 7, "a", "b", "c"), (2, "first line of all\nother", 7, "a", "b", "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, _drop long, _text string, _TEXT_ string, _id string")
    out = ld.dedup_lines(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [docs[0], (2, "other", *docs[1][2:])]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ld.line_report(none).count() == 0 and ld.dedup_lines(none).count() == 0


def test_native(spark):
    plan = ld.line_report(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
