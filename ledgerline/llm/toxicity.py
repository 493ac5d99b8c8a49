"""Toxicity from two class-conditional Kneser-Ney word models.

Each class, toxic and ordinary, has discounted counts of its own for every word. The discounted mass
goes to one backoff distribution that both share: the Kneser-Ney continuation counts, the number of
different words a word follows anywhere in the labelled texts. The evidence of a word is the
difference of its two log-probabilities, less its sampling error and less a gate: languages and
topics are spread unevenly over the classes, and a small difference on every word would outweigh the
few words that matter. A document's evidence is the mean over its words; a logistic curve, fitted on
labelled rows that the counts did not see, turns it into a score.

Words that make up a large enough share of the labelled text are weighed where a document is split, from
a broadcast table whose size that share bounds. Of all other words only those that a bitmap of fixed size
does not rule out leave the document and meet their evidence by key.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import bucket_of, text_hash, text_of
from ledgerline.llm.exact_dedup import Filter
from ledgerline.llm.quality_model import bounded, learnable
from ledgerline.session import materialize

#: Rows the logistic curve is fitted on at most, thinned by a hash of the id; words are counted on all others.
FIT_ROWS = 200_000
#: A log ratio counts as far as it exceeds this, plus this share of its standard error.
GATE, ERROR_SHARE = 1.5, 0.5
THRESHOLD = 0.3
#: A word is frequent when it is more than one in this many of the counted words with evidence; so no more can exist.
FREQUENT_WORDS = 1 << 19
#: Bits that rule out words without evidence (16 MB).
RARE_BITS = 1 << 27
#: Remainders of crc32(id) modulo four: held out, calibration; the other two are counted.
HELD_OUT, CALIBRATION = 2, 3

_WORD = re.compile(r"[^\W\d_]+")
_KNOWN_WORDS = 200_000
_TOKENS_AT_ONCE = 1 << 21


class WordKeys(dict):
    """Signed 64-bit keys of words, remembered up to a number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _KNOWN_WORDS:
            self.clear()
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        self[word] = key = h - (1 << 64) if h >> 63 else h
        return key

    def of(self, text: str) -> np.ndarray:
        words = _WORD.findall(text.lower())
        return np.fromiter((self[w] for w in words), dtype=np.int64, count=len(words))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (before null) and distinct pairs, each once for a run of texts."""
    known, texts, labels, tokens = WordKeys(), [], [], 0

    def flush():
        words = np.concatenate([*texts, np.zeros(0, np.int64)])
        toxic = np.repeat(np.array(labels, dtype=np.int64), [len(t) for t in texts])
        keys, where, n = np.unique(words, return_inverse=True, return_counts=True)
        t = np.bincount(where, weights=toxic, minlength=len(keys)).astype(np.int64)
        pairs = np.unique(np.concatenate([np.stack([t[:-1], t[1:]], axis=1) for t in texts if len(t) > 1] or [np.zeros((0, 2), np.int64)]), axis=0)
        none = np.zeros(len(pairs), np.int64)
        before = pa.concat_arrays([pa.nulls(len(keys), pa.int64()), pa.array(pairs[:, 0])])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([keys, pairs[:, 1]])), before, pa.array(np.concatenate([t, none])), pa.array(np.concatenate([n - t, none]))],
            names=["word", "before", "toxic", "ordinary"],
        )

    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1), strict=True):
            texts.append(known.of(text.as_py()))
            labels.append(label.as_py())
            tokens += len(texts[-1])
            if tokens > _TOKENS_AT_ONCE:
                yield flush()
                texts, labels, tokens = [], [], 0
    yield flush()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, toxic, ordinary, continuations) of labelled texts (text, label)."""
    counted = texts.select("text", "label").mapInArrow(_counted, "word bigint, before bigint, toxic bigint, ordinary bigint")
    # a pair counts once, however many texts hold it
    distinct = counted.groupBy("word", "before").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    return distinct.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"), F.count("before").alias("continuations"))


def log_ratios(counts: DataFrame, gate: float = GATE, error_share: float = ERROR_SHARE) -> DataFrame:
    """(word, ratio, times) of the words with evidence for either class; ``times`` they were counted."""
    sums = [F.count(F.lit(1)), F.sum("continuations")]
    for c in ("toxic", "ordinary"):
        sums += [F.sum(c), F.count(F.when(F.col(c) > 0, 1)), F.count(F.when(F.col(c) == 1, 1)), F.count(F.when(F.col(c) == 2, 1))]
    words, continuations, *of = counts.agg(*sums).first()
    shared = (F.col("continuations") + 0.5) / (float(continuations or 0) + 0.5 * max(1, words))

    def log_p(c, total, kinds, once, twice):
        d = once / (once + 2 * twice) if once and twice else 0.5
        return F.log((F.greatest(F.col(c) - d, F.lit(0.0)) + F.lit(d * kinds) * shared) / F.lit(float(total or 1)))

    ratio = log_p("toxic", *of[:4]) - log_p("ordinary", *of[4:])
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("ordinary") + 0.5))
    beyond = F.signum(ratio) * F.greatest(F.abs(ratio) - gate - error_share * error, F.lit(0.0))
    return counts.select("word", beyond.alias("ratio"), (F.col("toxic") + F.col("ordinary")).alias("times")).where("ratio <> 0")


def _bitmap(words: DataFrame) -> np.ndarray:
    """Bits at the lowest ``RARE_BITS`` values of the words' keys, put together by tasks in slices of 4 KB."""
    place = F.col("word").bitwiseAND(F.lit(RARE_BITS - 1)) + 1
    slices = words.groupBy(F.bitmap_bucket_number(place).alias("slice")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    held = np.zeros(RARE_BITS // 8, dtype=np.uint8)
    for at, bits in slices.collect():
        held[4096 * (at - 1) : 4096 * at] = np.frombuffer(bits, dtype=np.uint8)
    return held


def _weighed(known_words):
    """Number of words of each text, the sum of its frequent words' ratios, and the distinct other words that may have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (frequent, ratios, bits) = WordKeys(), known_words.value
        for batch in batches:
            totals, sums, words, counts = [], [], [], []
            for text in batch.column(3):
                w, n = np.unique(known.of(text.as_py()), return_counts=True)
                at = np.minimum(np.searchsorted(frequent, w), len(frequent) - 1)
                is_frequent = frequent[at] == w
                low = w & (RARE_BITS - 1)
                rest = ~is_frequent & ((bits[low >> 3] >> (low & 7)) & 1).astype(bool)
                totals.append(int(n.sum()))
                sums.append(float((ratios[at] * n)[is_frequent].sum()))
                words.append(w[rest])
                counts.append(n[rest])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(totals, pa.int64()), pa.array(sums, pa.float64()), pa.array(words, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "fold", "n_words", "frequent", "word", "n"],
            )

    return run


def evidence(rows: DataFrame, ratios: DataFrame, frequent: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_hash, fold, evidence) of rows (doc_id, text_hash, fold, text): the mean ratio of a text's words.

    ``ratios`` (word, ratio) is joined by key and may have any number of words; ``frequent``, of a bounded number
    and none of them in ``ratios``, is broadcast.
    """
    spark = rows.sparkSession
    # one key that no text looks up more than any other word keeps the table from being empty
    table = np.array([(0, 0.0)], dtype=[("word", np.int64), ("ratio", np.float64)])
    if frequent is not None:
        found = frequent.select("word", "ratio").toArrow().to_pandas().sort_values("word")
        if len(found):
            table = found.to_records(index=False)
    known_words = spark.sparkContext.broadcast((np.ascontiguousarray(table["word"]), np.ascontiguousarray(table["ratio"]), _bitmap(ratios)))
    kinds = "doc_id bigint, text_hash bigint, fold bigint, n_words bigint, frequent double, word array<bigint>, n array<bigint>"
    held = materialize(rows.mapInArrow(_weighed(known_words), kinds).withColumn("row", F.monotonically_increasing_id()), "text_words")
    document = ["row", "doc_id", "text_hash", "fold", "n_words", "frequent"]
    words = held.where(F.size("word") > 0).select(*document, F.inline(F.arrays_zip("word", "n")))
    looked_up = words.join(ratios.select("word", "ratio"), "word", "left").groupBy(*document).agg(F.coalesce(F.sum(F.col("ratio") * F.col("n")), F.lit(0.0)).alias("rare"))
    sums = looked_up.unionByName(held.where(F.size("word") == 0).select(*document, F.lit(0.0).alias("rare")))
    return sums.select("doc_id", "text_hash", "fold", F.when(F.col("n_words") > 0, (F.col("frequent") + F.col("rare")) / F.col("n_words")).otherwise(0.0).alias("evidence"))


def score_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, text_hash, held_out, evidence, score, predicted`` for every row of ``docs``.

    Labels are learned from rows whose crc32 of the id does not leave 2 modulo four; equal labelled
    texts are counted once, as toxic if any label says so. A null text is empty; a text without words
    has no evidence either way. Without labelled rows, or with one class only, the score is the
    smoothed share of toxic rows. Repeated rows each get a row, a null id is scored, other columns
    are ignored, no rows give no rows.
    """
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_hash(docs["text"]).alias("text_hash"), bucket_of(docs["doc_id"], 4).alias("fold"), text_of(docs).alias("text"))
    learned = materialize(learnable(labels, "toxic").where(bucket_of(F.col("doc_id"), 4) != HELD_OUT), "toxic_labels")
    counting = learned.where(bucket_of(F.col("doc_id"), 4) != CALIBRATION)
    once = materialize(rows.select("doc_id", "text_hash").join(counting, "doc_id").groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label")), "toxic_texts")
    # most unlabelled texts are ruled out before the join, so that they are not shuffled; the same join at every size
    labelled = Filter(once, ["doc_id", "text_hash"]).mark(rows, ["doc_id", "text_hash"], "labelled").where("labelled").join(once.hint("merge"), ["doc_id", "text_hash"])
    counts = materialize(word_counts(labelled.select("text", "label")), "words")
    ratios = materialize(log_ratios(counts), "word_ratios")
    is_frequent = F.col("times") * FREQUENT_WORDS > (ratios.agg(F.sum("times")).first()[0] or 0)
    measured = materialize(evidence(rows, ratios.where(~is_frequent), ratios.where(is_frequent)), "evidence")
    calibrating = bounded(learned.where(bucket_of(F.col("doc_id"), 4) == CALIBRATION), fit_rows)
    slope, intercept = _curve(measured.where(F.col("fold") == CALIBRATION).join(calibrating, "doc_id").select("label", "evidence"))
    score = 1 / (1 + F.exp(-(F.col("evidence") * slope + intercept)))
    return measured.select("doc_id", "text_hash", (F.col("fold") == HELD_OUT).alias("held_out"), "evidence", score.alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    )


def _curve(rows: DataFrame) -> tuple[float, float]:
    n, ones = rows.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if ones in (0, n):
        return 0.0, math.log((ones + 1) / (n - ones + 1))
    fitted = LogisticRegression(labelCol="label", featuresCol="x", regParam=1e-6, maxIter=100).fit(rows.select("label", array_to_vector(F.array("evidence")).alias("x")))
    return max(0.0, float(fitted.coefficients[0])), float(fitted.intercept)
