from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from ledgerline.llm import packing

WEIRD = ["", " ", "<|endoftext|>", "a<|endoftext|> b", "<|endoftext|", "x" * 5000, "é" * 3000, "\n\n\t  \r\n end  ", "日本語テキスト 🙂 ok", "it's we'll I'M '", " nbsp sep", "12345 6789,0.1", "a\x00b", " lead", "trail   "]


def test_encoder_equals_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoder("byte_bpe_50k.json")
    for t in WEIRD:
        assert encode(t).tolist() == model.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("n", [1, 1023, 1024, 1025, 2048, 5000])
def test_cuts(n):
    got = packing.cuts(n, 1024)
    assert sum(k for _, k in got) == n and all(k == 1024 for _, k in got[1:]) and got[0][0] == 0
    assert all(a + k == b for (a, k), (b, _) in zip(got, got[1:], strict=False))


def unfold(runs, capacity):
    bins = {}
    for size, _, ranks, first, each, offset in runs:
        for r in range(ranks):
            bins.setdefault(first + r // each, []).append((offset + r % each * size, size))
    for parts in bins.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity
    return bins


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_gapless_and_close_to_the_bound(seed):
    r = random.Random(seed)
    sizes = [min(1024, max(1, int(r.lognormvariate(5.3, 1.1)))) for _ in range(3000)] + [1024] * 20 + [512] * 7
    counts = {}
    for s in sizes:
        counts[s] = counts.get(s, 0) + 1
    runs = packing.plan_sequences(counts, 1024)
    bins = unfold(runs, 1024)
    assert sorted(s for b in bins.values() for _, s in b) == sorted(sizes)
    assert all(sum(3 * s > 1024 for _, s in b) <= 2 for b in bins.values())
    # ranks of a size are covered once
    for s in counts:
        at = 0
        for _, a, n, *_ in sorted(x for x in runs if x[0] == s):
            assert a == at
            at += n
        assert at == counts[s]
    lower = max(-(-sum(sizes) // 1024), sum(2 * s > 1024 for s in sizes))
    assert len(bins) <= lower * 1.02 + 1


def test_large_pairs_are_a_largest_matching():
    assert len(unfold(packing.plan_sequences({600: 2, 424: 1, 400: 2, 350: 1}, 1024), 1024)) == 3


def test_documents(spark):
    docs = [(i, t, "seq", 1) for i, t in enumerate(WEIRD)] + [(0, "", "x", 1), (0, "", "x", 1), (None, None, "x", 1)] + [(100 + i, "word " * i, "x", 2) for i in range(0, 3000, 97)]
    df = spark.createDataFrame(docs, "doc_id long, text string, ids string, sequence_id int")
    got = packing.pack(df).collect()
    encode = packing.encoder("byte_bpe_50k.json")
    want = []
    for i, t, *_ in docs:
        ids = np.append(encode(t or ""), np.uint32(2)).astype("<u4")
        want += [(i, p, a, n, zlib.crc32(ids[a : a + n].tobytes())) for p, (a, n) in enumerate(packing.cuts(len(ids), 1024))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], zlib.crc32(r["ids"])) for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
