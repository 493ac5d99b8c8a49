"""Each stage of the pipeline against plain code on its own input."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

import corpus_pipeline as p
from ledgerline.llm import decontaminate, packing, quality_rules
from ledgerline.session import materialize
from tests.llm.test_decontaminate import plain_tiles
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_quality_rules import plain_counts
from tests.llm.test_simhash import plain_components, plain_jaccard, plain_set


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in p.STAGES:
        after = materialize(stage(spark, docs, sf_dir), "test_stage")
        out.append((name, docs, after))
        docs = after
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns(stages):
    wanted = stages[0][1].dtypes
    assert all(after.dtypes == wanted for _, _, after in stages[:-1])


def test_quality_rules(spark, sf_dir, stages):
    _, before, after = stages[0]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    verdict = {r["doc_id"]: r for r in quality_rules.quality(before, labels).collect()}
    kept = texts(after)
    for doc_id, text in texts(before).items():
        n = plain_counts(text)
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        assert verdict[doc_id]["base_failed"] == failed
        assert (doc_id in kept) == (not failed and verdict[doc_id]["log_ratio"] >= quality_rules.MIN_LOG_RATIO)
        assert doc_id not in kept or kept[doc_id] == text


def test_line_dedup(stages):
    _, before, after = stages[1]
    want, _ = plain_lines(list(texts(before).items()))
    assert texts(after) == {d: t for d, t in want.items() if t.strip(" \t\n\x0b\x0c\r")}
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_near_duplicates(stages):
    _, before, after = stages[2]
    docs = texts(before)
    sets = {d: plain_set(t, p.NEAR_WORDS) for d, t in docs.items()}
    component = plain_components(sorted(sets), {d: d for d in sets}, lambda a, b: plain_jaccard(sets[a], sets[b]) >= p.NEAR_SIMILARITY)
    assert texts(after) == {d: t for d, t in docs.items() if component[d] == d}


def test_decontamination(spark, sf_dir, stages):
    _, before, after = stages[3]
    known = decontaminate.Words()
    items = [known.of(r["text"]).tolist() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    seeds = [{tuple(i[k : k + 5]) for k in range(len(i) - 4)} for i in items]
    want = {}
    for d, t in texts(before).items():
        words = known.of(t).tolist()
        own = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        hit = any(own & s and sum(n for n, _, _ in plain_tiles(words, i, 5)) >= decontaminate.MIN_COVERAGE * len(i) for i, s in zip(items, seeds, strict=True))
        if not hit:
            want[d] = t
    assert texts(after) == want and len(want) < before.count()


def test_packing(stages):
    _, before, after = stages[4]
    encode, got = packing.encoder("byte_bpe_50k.json"), {}
    for r in after.collect():
        got.setdefault(r["doc_id"], {})[r["piece"]] = r
    docs = texts(before)
    assert set(got) == set(docs)
    bins = {}
    for d, t in docs.items():
        ids = np.append(encode(t), np.uint32(2)).astype("<u4")
        for n, (start, length) in enumerate(packing.cuts(len(ids), 1024)):
            r = got[d][n]
            assert (r["start"], r["length"], r["ids_crc32"]) == (start, length, zlib.crc32(ids[start : start + length].tobytes()))
            bins.setdefault(r["sequence_id"], []).append((r["offset"], length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_run_equals_its_stages(spark, sf_dir, stages):
    a, b = (sorted(map(tuple, df.select("doc_id", "piece", "start", "length", "ids_crc32").collect())) for df in (p.run(spark, sf_dir), stages[-1][2]))
    assert a == b


def test_empty_documents(spark, sf_dir):
    docs = spark.createDataFrame([], spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    for _, stage in p.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "test_stage")
    assert docs.count() == 0
