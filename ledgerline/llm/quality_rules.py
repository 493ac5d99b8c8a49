"""Quality rules: base counts and a hashed n-gram log-likelihood ratio for whole texts.

Words and word pairs are hashed into a fixed number of buckets. One multinomial over the buckets is
counted on trusted documents, one on the whole corpus; a document's score is the mean, over its
words and pairs, of the log ratio of the two. Every document is decided by the same threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import text_hash, text_of
from ledgerline.llm.exact_dedup import Filter
from ledgerline.session import materialize

BUCKETS = 1 << 16
#: A document is kept when its mean log ratio reaches this.
MIN_LOG_RATIO = -0.12
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Pseudo-counts a bucket on average, spread like the corpus: the fewer trusted texts there are, the
#: less a bucket that none of them has says against a document.
SMOOTHING = 4.0

_SPACES, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
_KNOWN_WORDS = 200_000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))

RESULT = "doc_id bigint, text_hash bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, log_ratio double"


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((self[w] for w in words), dtype=np.uint64, count=len(words))


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    """Bucket of every word, then of every pair of neighbours."""
    pairs = hashes[:-1] * _A + hashes[1:] * _B
    mixed = np.concatenate([hashes, pairs]) * _C
    return (mixed >> np.uint64(48)).astype(np.int64)


def repeated_words(hashes: np.ndarray) -> int:
    """Words inside a window of three that the text holds twice or more."""
    if len(hashes) < 3:
        return 0
    windows = hashes[:-2] * _A + hashes[1:-1] * _B + hashes[2:] * _C
    order = np.argsort(windows, kind="stable")
    same = np.diff(windows[order]) == 0
    twice = np.zeros(len(windows), dtype=bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    inside = np.zeros(len(hashes), dtype=bool)
    for shift in range(3):
        inside[shift : shift + len(windows)] |= twice
    return int(inside.sum())


def repeated_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            n += line in seen
            seen.add(line)
    return n


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, raw, trusted = WordHashes(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text, is_trusted in zip(batch.column(0), batch.column(1), strict=True):
            n = np.bincount(buckets_of(known.of(text.as_py().encode("utf-8", "surrogatepass").split())), minlength=BUCKETS)
            raw += n
            if is_trusted.as_py():
                trusted += n
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(trusted[at])], names=["bucket", "raw", "trusted"])


def _marked(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(text, is_trusted) of every row of ``docs`` (doc_id, text).

    A bitmap of bounded size rules out most ids that are not trusted, so that only the other texts are shuffled
    to meet their ids; a null id is not trusted. The join is one by merging at every size, so that its cost is
    in proportion to the texts from small tables on.
    """
    ids = materialize(trusted.select("doc_id"), "trusted_ids")
    sieved = Filter(ids, ["doc_id"]).mark(docs, ["doc_id"], "in_bitmap").withColumn("in_bitmap", F.col("in_bitmap") & F.col("doc_id").isNotNull())
    met = sieved.where("in_bitmap").join(ids.withColumn("is_trusted", F.lit(True)).hint("merge"), "doc_id", "left")
    return met.select("text", F.coalesce("is_trusted", F.lit(False)).alias("is_trusted")).unionByName(sieved.where("not in_bitmap").select("text", F.lit(False).alias("is_trusted")))


def log_ratios(docs: DataFrame, trusted: DataFrame, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log ratio of each bucket. ``docs``: (doc_id, text); ``trusted``: distinct ids, of any number."""
    marked = _marked(docs, trusted)
    # each task sends one row for a bucket at most
    counts = marked.mapInArrow(_counts, "bucket bigint, raw bigint, trusted bigint")
    rows = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toPandas()  # `BUCKETS` rows at most
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[rows["bucket"]], good[rows["bucket"]] = rows["raw"], rows["trusted"]
    corpus = (raw + 0.5) / (raw.sum() + 0.5 * BUCKETS)
    prior = smoothing * BUCKETS
    return np.log((good + prior * corpus) / (good.sum() + prior)) - np.log(corpus)


def _scored(ratios):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = WordHashes(), ratios.value
        for batch in batches:
            out = []
            for text in batch.column(2):
                text = text.as_py()
                raw = text.encode("utf-8", "surrogatepass")
                hashes = known.of(raw.split())
                buckets = buckets_of(hashes)
                out.append(
                    (
                        len(hashes),
                        len(text) - (len(raw) - len(raw.translate(None, _SPACES))),
                        len(raw) - len(raw.translate(None, _SYMBOLS)),
                        repeated_lines(text),
                        repeated_words(hashes),
                        float(table[buckets].mean()) if len(buckets) else 0.0,
                    )
                )
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ratio"]
            columns = [pa.array(c, pa.float64() if n == "log_ratio" else pa.int64()) for c, n in zip(zip(*out, strict=True) if out else [[]] * 6, names, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "text_hash", *names])

    return run


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Distinct ids labelled as good."""
    return labels.where((labels["quality"] == 1) & labels["doc_id"].isNotNull()).select(labels["doc_id"].cast("bigint").alias("doc_id")).distinct()


def quality(docs: DataFrame, labels: DataFrame, min_log_ratio: float = MIN_LOG_RATIO, smoothing: float = SMOOTHING) -> DataFrame:
    """Base counts, log ratio and verdict of every row of ``docs``.

    Returns ``doc_id, text_hash``, the counts of ``RESULT``, ``log_ratio``, ``base_failed`` and
    ``kept``. A null text has no words; a text without words has ratio 0 and fails the base. Rows with
    a null id are judged like others, repeated rows each get a row, other columns are ignored. No
    trusted document at all leaves a constant ratio pattern of the corpus; no rows give no rows.
    """
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_hash(docs["text"]).alias("text_hash"), text_of(docs).alias("text"))
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(rows.select("doc_id", "text"), trusted_ids(labels), smoothing))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return (
        rows.mapInArrow(_scored(ratios), RESULT)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= min_log_ratio))
    )


def keep_good(docs: DataFrame, labels: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with their columns."""
    verdict = quality(docs, labels, smoothing=smoothing).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(verdict, docs["doc_id"].cast("bigint").eqNullSafe(verdict["_id"]) & (text_hash(docs["text"]) == verdict["_hash"]), "left_semi")
