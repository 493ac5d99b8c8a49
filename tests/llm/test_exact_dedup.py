from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest

from ledgerline.llm import exact_dedup
from ledgerline.llm.queries import ORACLES, QUERIES
from tests.compare import connect, difference

LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, source string"


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        ordered = sorted(ids, key=lambda i: (i is not None, i or 0))
        for place, doc_id in enumerate(ordered):
            out.append((doc_id, keep, len(ids), place == len(ids) - 1, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [
    (1, "One text", "a"), (2, "one TEXT", "b"), (3, "one text ", "a"), (4, None, "a"), (5, "", "a"), (6, "", None),
    (7, "É", "a"), (8, "é", "a"), (9, "x" * 300 + "a", "a"), (10, "X" * 300 + "A", "a"), (11, "x" * 300 + "b", "a"),
    (12, "again", "a"), (12, "again", "a"), (12, "AGAIN", "z"), (None, "again", "a"), (None, "lost", "a"), (None, "lost", "a"),
    (13, "eno text", "a"), (14, "long " * 100_000, "a"), (15, "LONG " * 100_000, "a"), (16, "alone", "a"),
]


def test_equals_brute_force(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    found = exact_dedup.mark_copies(docs, digest_all=True).collect()
    assert sorted(map(tuple, found), key=str) == brute(ROWS)


def test_texts_told_apart_early_are_not_hashed(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    found = {r.doc_id: r.text_sha256 for r in exact_dedup.mark_copies(docs).collect()}
    assert found[16] is None and found[1] is not None


def test_one_group_holds_most_rows(spark):
    rows = [(i, f"copy{i % 3 == 2 and i}", "a") for i in range(6000)]
    found = exact_dedup.mark_copies(spark.createDataFrame(rows, SCHEMA), digest_all=True).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_BITS", 2)
    found = exact_dedup.mark_copies(spark.createDataFrame(ROWS, SCHEMA), digest_all=True).collect()
    assert sorted(map(tuple, found), key=str) == brute(ROWS)


def test_drop_keeps_one_row_a_text_with_all_columns(spark):
    docs = spark.createDataFrame([(*r, 5, "x") for r in ROWS], SCHEMA + ", length int, candidate string")
    found = exact_dedup.drop_copies(docs)
    assert found.columns == docs.columns
    kept = {(r.doc_id, (r.text or "").translate(LOWER)) for r in found.collect()}
    last = defaultdict(list)
    for doc_id, text, _ in ROWS:
        last[(text or "").translate(LOWER)].append(-1 if doc_id is None else doc_id)
    assert kept == {(None if max(ids) < 0 else max(ids), text) for text, ids in last.items()}
    assert found.count() == len(kept)


@pytest.mark.parametrize("mark", [exact_dedup.mark_copies, exact_dedup.drop_copies])
def test_empty_table(spark, mark):
    assert mark(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_sql(spark, sf_dir):
    actual = QUERIES["op11_exact_dedup"](spark, sf_dir).toPandas()
    assert difference(actual, connect(sf_dir).execute(ORACLES["op11_exact_dedup"]).df()) is None
