"""Benchmark decontamination by greedy string tiling.

Texts are word sequences (lower case, letters and digits). Running Karp-Rabin hashes of windows of
``MIN_MATCH`` words join a document with the benchmark items it shares a window with. For each such
pair the longest match of words not yet marked is marked again and again, in both texts, until none of
``MIN_MATCH`` words is left. The marked share of the item is its coverage: tiles may lie in any
order, so a passage whose parts were moved is found as well.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ledgerline.llm.common import text_hash, text_of
from ledgerline.llm.toxicity import WordKeys
from ledgerline.session import materialize

MIN_MATCH = 5
MIN_COVERAGE = 0.6
#: Characters of benchmark text that one pass over the documents looks for; more text takes more passes.
BLOCK_CHARS = 8_000_000
#: Words of a document whose windows are hashed together.
_WORDS_AT_ONCE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)

_WORD = re.compile(r"[^\W_]+")


class Words(WordKeys):
    def of(self, text: str) -> np.ndarray:
        words = _WORD.findall(text.lower())
        return np.fromiter((self[w] for w in words), dtype=np.int64, count=len(words))


def window_hashes(words: np.ndarray, n: int = MIN_MATCH) -> np.ndarray:
    """Polynomial hash, modulo 2**64, of every window of ``n`` words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    values, out = words.view(np.uint64), np.zeros(count, np.uint64)
    for k in range(n):
        out = out * _BASE + values[k : k + count]
    return out


def maximal_matches(places: np.ndarray, starts: np.ndarray, n: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(length, start in item, start in document) of the runs that equal windows form on a diagonal."""
    order = np.lexsort((places, places - starts))
    p, s = places[order], starts[order]
    cut = np.flatnonzero((np.diff(p) != 1) | (np.diff(p - s) != 0)) + 1
    first, last = np.r_[0, cut], np.r_[cut, len(p)] - 1
    return [(int(p[b] - p[a]) + n, int(s[a]), int(p[a])) for a, b in zip(first, last, strict=True)]


def tiles(matches: list[tuple[int, int, int]], n: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiling: the longest match over unmarked words is marked until none of ``n`` words is left.

    Of equal lengths the one first in the item, then in the document, is taken. A match that meets
    marked words is put back as the parts between them.
    """
    heap = [(-length, i, d) for length, i, d in matches]
    heapq.heapify(heap)
    in_item, in_doc, out = set(), set(), []
    while heap:
        length, i, d = heapq.heappop(heap)
        length = -length
        free = [k for k in range(length) if i + k not in in_item and d + k not in in_doc]
        if len(free) == length:
            out.append((length, i, d))
            in_item.update(range(i, i + length))
            in_doc.update(range(d, d + length))
            continue
        at = 0
        while at < len(free):
            end = at
            while end + 1 < len(free) and free[end + 1] == free[end] + 1:
                end += 1
            if end - at + 1 >= n:
                heapq.heappush(heap, (-(end - at + 1), i + free[at], d + free[at]))
            at = end + 1
    return out


class Index:
    """Windows of a block of benchmark items: sorted hashes, and the items and places of each."""

    def __init__(self, items: list[tuple[int, str]]):
        known = Words()
        self.ids = [i for i, _ in items]
        words = [known.of(t) for _, t in items]
        self.sizes = [len(w) for w in words]
        hashes = [window_hashes(w) for w in words]
        flat = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.item = np.repeat(np.arange(len(items)), [len(h) for h in hashes])[order]
        self.start = np.concatenate([*(np.arange(len(h)) for h in hashes), np.zeros(0, np.int64)])[order]
        self.hashes, first, n = np.unique(flat[order], return_index=True, return_counts=True)
        self.first, self.count = first, n

    def shared(self, words: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Item -> (places in the document, starts in the item) of the equal windows."""
        found = []
        for at in range(0, max(1, len(words)), _WORDS_AT_ONCE):
            hashes = window_hashes(words[at : at + _WORDS_AT_ONCE + MIN_MATCH - 1])
            if not len(hashes) or not len(self.hashes):
                continue
            slot = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            places = np.flatnonzero(self.hashes[slot] == hashes)
            found.append(np.stack([places + at, slot[places]]))
        if not found or not sum(f.shape[1] for f in found):
            return {}
        places, slots = np.concatenate(found, axis=1)
        n = self.count[slots]
        entries = np.repeat(self.first[slots], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        places = np.repeat(places, n)
        out = defaultdict(list)
        order = np.argsort(self.item[entries], kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(self.item[entries][order])) + 1):
            out[int(self.item[entries[part[0]]])] = (places[part], self.start[entries[part]])
        return out


FOUND = StructType(
    [
        StructField("doc_id", LongType()), StructField("text_hash", LongType()), StructField("item_id", LongType()), StructField("coverage", DoubleType()),
        StructField("covered_words", IntegerType()), StructField("item_words", IntegerType()), StructField("n_tiles", IntegerType()),
    ]
)
_ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]


def _searched(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = shared.value, Words()
        for batch in batches:
            rows = []
            for row, text in enumerate(batch.column(2)):
                for item, (places, starts) in index.shared(known.of(text.as_py())).items():
                    marked = tiles(maximal_matches(places, starts))
                    covered = sum(length for length, _, _ in marked)
                    rows.append((batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), index.ids[item], covered / index.sizes[item], covered, index.sizes[item], len(marked)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, _ARROW, strict=True)], names=FOUND.names)

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``FOUND`` rows of every document row and benchmark row that share a window of words.

    A null text is empty. Items of fewer than ``MIN_MATCH`` words prove nothing and match nothing. Equal
    benchmark rows count once, repeated document rows each have their own result rows, null ids are
    kept. Other columns are ignored. The benchmark is taken in blocks of bounded text, each of which is
    searched for in all documents; no rows on either side give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_hash(docs["text"]).alias("text_hash"), text_of(docs).alias("text"))
    items = materialize(benchmark.select(benchmark["item_id"].cast("bigint").alias("item_id"), text_of(benchmark).alias("text")).distinct(), "benchmark")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = -(-chars // block_chars)
    found = spark.createDataFrame([], FOUND)
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about `block_chars` of text
        shared = spark.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in sorted(part, key=lambda r: (str(r["item_id"]), r["text"]))]))
        found = found.unionByName(rows.mapInArrow(_searched(shared), FOUND))
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``overlaps`` whose coverage reaches ``min_coverage``."""
    return overlaps(docs, benchmark, block_chars).where(F.col("coverage") >= min_coverage)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; columns as they are."""
    found = leaks(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(found, docs["doc_id"].cast("bigint").eqNullSafe(found["_id"]) & (text_hash(docs["text"]) == found["_hash"]), "left_anti")
