from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from ledgerline.llm import licenses as lic

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def starts(words, phrase):
    p = phrase.split()
    return [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]


def plain(texts):
    tokens = [words_of(t) for t in texts]
    df = Counter(w for ws in tokens for w in set(ws))
    idf = {w: math.log((len(texts) + 1) / (df[w] + 1)) + 1e-3 for w in lic.VOCABULARY}
    out = []
    for ws in tokens:
        base = sorted((s, name) for phrase, name in lic.BASE.items() for s in starts(ws, phrase))
        rare = {w for _, w in sorted(((idf[w], w) for w in set(ws) & set(idf)), reverse=True)[: lic.LOOKED_UP]}
        labels, score = {n for _, n in base}, 0.0
        for name, phrase, text in lic.NOTICES:
            parts = lic.telling(text.split())
            full = sum(idf[w] for w, _ in parts)
            met = defaultdict(float)
            for w, at in parts:
                for i, x in enumerate(ws):
                    if x == w and w in rare:
                        met[i - at] += idf[w] / full
            inside = starts(text.split(), phrase)[0]
            good = [met[s - inside] for s in starts(ws, phrase) if met.get(s - inside, 0) >= lic.MIN_WEIGHT]
            if good:
                labels.add(name)
                score = max(score, *good)
        out.append((len(ws), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({n for _, n in base})), ",".join(sorted(labels)), min(1.0, score)))
    return out


def corpus():
    r = random.Random(2)
    filler = ["lorem", "the", "Ipsum", "by", "2", "license", "Public", "déjà", "version", "x_y", "mit"]
    texts = [None, "", "...", "Released under the MIT License.", "under the MIT license under the mit License", "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0 and cc by nc",
             "This work is licensed under the GNU General Public License, version 3.", "All rights reserved.", "all Rights. reserved under the mit", "mit license under the", "the mit license", "LicenKe apache",
             "under the mit license", "under the mİt license"]
    for _, _, text in lic.NOTICES:
        texts += [" ".join(r.choices(filler, k=30)) + " " + text.title() + ". " + " ".join(r.choices(filler, k=20)), " ".join(w for w in text.split() if r.random() < 0.7)]
    texts += [" ".join(r.choices(filler, k=300)) for _ in range(20)]
    texts += ["license mit apache cc " * 5000, "word " * 20_000 + "under the mit license"]
    return texts


def test_equals_plain(spark):
    texts = corpus()
    rows = [(i, t, "n", 1) for i, t in enumerate(texts)] + [(None, texts[3], "n", 1), (3, texts[3], "n", 1)]
    got = lic.scan(spark.createDataFrame(rows, "doc_id long, text string, hits string, n_words int")).collect()
    want = plain([r[1] for r in rows])
    key = lambda x: (str(x[0]), str(x[1:6]))
    g = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) for r in got), key=key)
    w = sorted(((r[0], *x) for r, x in zip(rows, want, strict=True)), key=key)
    assert [x[:7] for x in g] == [x[:7] for x in w]
    assert all(a[7] == pytest.approx(b[7]) for a, b in zip(g, w, strict=True))
    assert any("gpl-3" in x[6] for x in g) and any("bsd" in x[6] for x in g)


def test_empty(spark):
    assert lic.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_notices_in_one_file(spark):
    mit, gpl = lic.NOTICES[1], lic.NOTICES[5]
    both = mit[2] + " " + "filler " * 20 + gpl[2]
    # the words of the second notice are common in the corpus, those of the first are not
    rows = [(0, both)] + [(i, gpl[2]) for i in range(1, 30)] + [(100, " x ".join(text for *_, text in lic.NOTICES))]
    got = {r["doc_id"]: r["labels"] for r in lic.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == "gpl-3,mit"
    assert set(got[100].split(",")) == {label for label, *_ in lic.NOTICES}
