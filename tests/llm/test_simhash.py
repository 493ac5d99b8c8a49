from __future__ import annotations

import random
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerline.llm import simhash
from ledgerline.llm.graph import components


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({c: 32 for c in range(9, 14)}).split(" ") if w]
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, least, linked):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in combinations(values, 2):
        if linked(a, b):
            root[find(a)] = find(b)
    groups = {}
    for v in values:
        groups.setdefault(find(v), []).append(v)
    return {v: min((least[x] for x in g if least[x] is not None), default=None) for g in groups.values() for v in g}


TEXTS = ["", None, "one", "One  TWO", "a b c", "A\tB\nC", "ÄB c ä", "x " * 3000, "word joined by nbsp here", *(" ".join(random.Random(i).choices("abcdefgh", k=40)) for i in range(30))]


def test_fingerprint_equals_plain():
    for t in TEXTS:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_fingerprint_is_spark_xxhash64(spark):
    got = spark.sql("select xxhash64('a b c')").first()[0]
    assert simhash.fingerprint("A b C") == got % (1 << 64)


def close_values(seed, n):
    """Values around a few centres, many within two bits of each other, plus far ones."""
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(4)]
    out = {0, (1 << 64) - 1}
    while len(out) < n:
        v = r.choice(centres)
        for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
            v ^= 1 << r.randrange(64)
        out.add(v if r.random() < 0.9 else r.getrandbits(64))
    return sorted(out)


@pytest.mark.parametrize("posting_rows", [1, 2, 48])
def test_components_equal_brute_force(spark, monkeypatch, posting_rows):
    monkeypatch.setattr(simhash, "POSTING_ROWS", posting_rows)
    values = close_values(posting_rows, 300)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {r["node"]: r["root"] for r in components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()}
    want = plain_components(signed, {v: v for v in signed}, lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2)
    assert {v: got.get(v, v) for v in signed} == want


def test_documents_with_nulls_ties_and_clashing_columns(spark):
    rows = [(i, t, "fp", 1) for i, t in enumerate(TEXTS)] + [(None, "lonely words of its own", "fp", 1), (3, TEXTS[3], "fp", 1), (40, TEXTS[20], "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id long")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fp = {r[1]: plain_fingerprint(r[1]) for r in rows}
    least = {}
    for i, t, *_ in rows:
        least[fp[t]] = min((x for x in (least.get(fp[t]), i) if x is not None), default=None)
    want = plain_components(sorted(least), least, lambda a, b: (a ^ b).bit_count() <= 2)
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got), key=str) == sorted(((i, fp[t], want[fp[t]]) for i, t, *_ in rows), key=str)


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, "a"), (2, text, "a"), (2, text, "a"), (2, text + " ", "b"), (9, "something else entirely here", "a"), (None, None, "a"), (None, None, "a")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == [2, 9, None]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(none).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.range(500).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in components(edges).collect()} == {0}


def plain_set(text, n):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def plain_jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_keep_one_by_similarity_equals_brute_force(spark):
    r = random.Random(12)
    docs = []
    for _ in range(12):
        words = [f"w{r.randrange(400)}" for _ in range(r.choice([3, 6, 30, 120, 300]))]
        for _ in range(6):
            rate = r.choice([0.005, 0.01, 0.02, 0.05])
            copy = [f"n{r.randrange(50)}" if r.random() < rate else w for w in words]
            docs.append((len(docs), " ".join(copy)))
    docs += [(900, ""), (901, None), (902, " \n"), (1, docs[1][1])]
    sets = {d: plain_set(t, 5) for d, t in docs}
    linked = lambda a, b: plain_jaccard(sets[a], sets[b]) >= 0.8
    component = plain_components(sorted(sets), {d: d for d in sets}, linked)
    kept = simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string"), 5, 0.8).collect()
    assert sorted(x["doc_id"] for x in kept) == sorted({component[d] for d in sets})
    missed = [(a, b) for a, b in combinations(sorted(sets), 2) if linked(a, b) and (plain_fingerprint(dict(docs)[a]) ^ plain_fingerprint(dict(docs)[b])).bit_count() > 2]
    assert len(missed) > 5


def test_pipeline_stage_drops_near_copies_beyond_two_bits(spark):
    import corpus_pipeline

    words = [f"word{i}" for i in range(200)]
    copy = [f"other{i}" if i in (40, 100, 160) else w for i, w in enumerate(words)]
    texts = {1: " ".join(words), 2: " ".join(copy), 3: " ".join(f"far{i}" for i in range(200))}
    assert (plain_fingerprint(texts[1]) ^ plain_fingerprint(texts[2])).bit_count() > 2
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "").collect()
    assert sorted(x["doc_id"] for x in kept) == [1, 3]


@pytest.mark.parametrize("similarity", [None, 0.8])
def test_keep_one_with_clashing_columns(spark, similarity):
    same = "one two three four five six seven"
    docs = [(1, same, 5, "x", "y", "z"), (2, same, 5, "x", "y", "z"), (3, "quite another text of eight words in all", 1, "x", "y", "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string, _copies long, _id string, _hash string, component_id string")
    out = simhash.keep_one(df, similarity=similarity)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [docs[0], docs[2]]


def near_copies(seed, copies, rates, words=150):
    r = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    return [(i, " ".join(f"n{i}x{j}" if r.random() < rates[i % len(rates)] else w for j, w in enumerate(base))) for i in range(copies)]


def recorded(monkeypatch):
    """Row counts of the tables that the operator stores."""
    seen, stored = {}, simhash.materialize

    def counting(df, name, *rest):
        out = stored(df, name, *rest)
        seen.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialize", counting)
    return seen


def test_pairs_of_a_large_group_of_near_copies_do_not_grow_with_its_square(spark, monkeypatch):
    seen = recorded(monkeypatch)
    words = [f"w{i}" for i in range(150)]
    docs = [(i, " ".join([*words[: i % 150], f"n{i}", *words[i % 150 + 1 :]])) for i in range(600)]
    assert [x["doc_id"] for x in simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string"), 5, 0.8).collect()] == [0]
    assert sum(seen["similar_candidates"]) < 2400


@pytest.mark.parametrize("posting_rows", [1, 4, 48])
def test_crowded_postings_lose_no_link(spark, monkeypatch, posting_rows):
    monkeypatch.setattr(simhash, "POSTING_ROWS", posting_rows)
    docs = near_copies(posting_rows, 90, [0.004, 0.01, 0.02, 0.03])
    sets = {d: plain_set(t, 5) for d, t in docs}
    component = plain_components(sorted(sets), {d: d for d in sets}, lambda a, b: plain_jaccard(sets[a], sets[b]) >= 0.8)
    assert 1 < len(set(component.values())) < 90
    got = simhash.similar_documents(spark.createDataFrame(docs, "doc_id long, text string"), 5, 0.8).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == component


def test_similarity_starts_from_verified_links_of_fingerprints(spark, monkeypatch):
    seen = recorded(monkeypatch)
    words = [f"w{i}" for i in range(3000)]
    docs = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, " ".join(f"far{i}" for i in range(100)))]
    bits = [simhash.majority(simhash.shingle_set(t, 5)) for _, t in docs]
    assert (bits[0] ^ bits[1]).bit_count() <= 2
    kept = simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string"), 5, 0.8).collect()
    assert sorted(x["doc_id"] for x in kept) == [1, 3]
    # the pair comes from the fingerprints and is verified; nothing is left for the join
    assert seen["similar_candidates"] == [1, 0] and seen["similar_links"] == [1, 0]
