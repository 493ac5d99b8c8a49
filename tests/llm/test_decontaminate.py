from __future__ import annotations

import random

import numpy as np
import pytest

from ledgerline.llm import decontaminate as d


def plain_tiles(doc, item, n):
    """Textbook greedy tiling: scan all starts for the longest unmarked match, mark it, repeat."""
    a, b, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                if k >= n and (best is None or k > best[0]):
                    best = (k, i, j)
        if best is None:
            return out
        k, i, j = best
        out.append(best)
        a[i : i + k], b[j : j + k] = [True] * k, [True] * k


@pytest.mark.parametrize("seed", range(12))
def test_tiling_equals_textbook(seed):
    r = random.Random(seed)
    words = "abc" if seed % 2 else "abcdefghijkl"
    item = [r.choice(words) for _ in range(r.randrange(5, 40))]
    doc = [r.choice(words) for _ in range(30)] + item[10:20] + [r.choice(words) for _ in range(5)] + item[:12]
    index = d.Index([(1, " ".join(item))])
    shared = index.shared(d.Words().of(" ".join(doc)))
    got = d.tiles(d.maximal_matches(*shared[0])) if shared else []
    assert got == plain_tiles(doc, item, d.MIN_MATCH)


def test_windows_across_blocks(monkeypatch):
    monkeypatch.setattr(d, "_WORDS_AT_ONCE", 4)
    item = " ".join(f"w{i}" for i in range(30))
    shared = d.Index([(1, item)]).shared(d.Words().of("x y z " + item))
    assert np.array_equal(np.sort(shared[0][0]), np.arange(3, 29))


def item_text(i):
    r = random.Random(i)
    return " ".join("".join(r.choices("aeioubcdfg", k=6)) for _ in range(40))


def rows():
    r = random.Random(99)
    noise = lambda k: " ".join("".join(r.choices("klmnopq", k=5)) for _ in range(k))
    words = item_text(1).split()
    return [
        (1, noise(50) + " " + item_text(0) + " " + noise(50), "s"),
        (2, noise(30) + " " + " ".join(words[20:]) + " " + noise(9) + " " + " ".join(words[:20]).upper() + ", " + noise(5), "s"),
        (3, noise(200), "s"),
        (4, " ".join(words[:10]) + " " + noise(100), "s"),
        (5, None, "s"),
        (6, "", "s"),
        (None, item_text(2), "s"),
        (1, noise(5), "s"),
        (7, item_text(0) + ". " + item_text(3), "s"),
        (7, item_text(0) + ". " + item_text(3), "s"),
        (8, noise(20_000) + " " + item_text(4), "s"),
    ]


@pytest.mark.parametrize("block_chars", [200, d.BLOCK_CHARS])
def test_documents(spark, block_chars):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, item_text(i), 1) for i in range(6)] + [(0, item_text(0), 1), (50, None, 1), (51, "too short", 1), (None, item_text(3), 1)], "item_id long, text string, coverage int")
    got = sorted(((r["doc_id"], r["item_id"], r["coverage"], r["n_tiles"]) for r in d.leaks(docs, bench, block_chars=block_chars).collect()), key=str)
    want = [(1, 0, 1.0, 1), (2, 1, 1.0, 2), (None, 2, 1.0, 1), (8, 4, 1.0, 1)] + [(7, i, 1.0, 1) for i in (0, 3, None)] * 2
    assert got == sorted(want, key=str)


def test_drop_leaks_and_empty(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    bench = spark.createDataFrame([(i, item_text(i)) for i in range(6)], "item_id long, text string")
    kept = d.drop_leaks(docs, bench).collect()
    assert sorted((r["doc_id"] for r in kept)) == [1, 3, 4, 5, 6]
    assert d.drop_leaks(docs, bench.limit(0)).count() == len(rows())
    assert d.leaks(docs.limit(0), bench).count() == 0
