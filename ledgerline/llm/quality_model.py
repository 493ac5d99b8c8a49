"""Sparse rule ensemble for document quality.

Statistics of whole texts feed a forest of shallow trees; every path of a tree becomes a rule, a
conjunction of bounds on statistics. A logistic regression with an absolute penalty weighs the rules
and drops most of them. What is left is compiled into one column expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import bucket_of, text_hash, text_of
from ledgerline.llm.quality_rules import WordHashes, repeated_lines, repeated_words
from ledgerline.session import materialize

STATISTICS = [
    "words", "mean_word", "longest_word", "distinct_words", "upper", "symbols", "pipes", "exclamations", "punctuation", "digits", "spaces", "repeated_lines", "repeated_words", "line_words",
]
TREES, DEPTH, PENALTY = 24, 3, 0.002
#: Labelled rows the model is fitted on at most, thinned by a hash of the id.
FIT_ROWS = 50_000
THRESHOLD = 0.3

_UPPER, _SYMBOLS, _PUNCTUATION, _DIGITS, _SPACES = bytes(range(65, 91)), b"#*$%&|<>", b".,;:?'\"()-", b"0123456789", b" \t\n\x0b\x0c\r"


def _share(raw: bytes, kinds: bytes) -> float:
    return (len(raw) - len(raw.translate(None, kinds))) / len(raw) if raw else 0.0


def statistics(text: str, known: WordHashes) -> tuple[float, ...]:
    """The values of ``STATISTICS`` for one text; zeros for one without words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return (0.0,) * len(STATISTICS)
    n, lines = len(words), text.split("\n")
    return (
        float(n),
        sum(map(len, words)) / n,
        float(max(map(len, words))),
        len(set(words)) / n,
        _share(raw, _UPPER),
        _share(raw, _SYMBOLS),
        _share(raw, b"|"),
        _share(raw, b"!"),
        _share(raw, _PUNCTUATION),
        _share(raw, _DIGITS),
        _share(raw, _SPACES),
        repeated_lines(text) / len(lines),
        repeated_words(known.of(words)) / n,
        n / len(lines),
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        rows = [statistics(t.as_py(), known) for t in batch.column(3)]
        columns = [pa.array(c, pa.float64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(STATISTICS))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *columns], names=["doc_id", "text_hash", "fold", *STATISTICS])


Rule = tuple[tuple[str, float, float], ...]  # (statistic, above, at most)


def paths_of(description: str) -> set[Rule]:
    """Every path from a root to a node below it, as bounds on statistics."""
    found: set[Rule] = set()
    open_: list[tuple[int, tuple[int, str, float]]] = []
    for line in description.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        open_ = [x for x in open_ if x[0] < depth] + [(depth, (int(m[2]), m[3], float(m[4])))]
        bounds: dict[int, list[float]] = {}
        for _, (feature, sign, value) in open_:
            b = bounds.setdefault(feature, [float("-inf"), float("inf")])
            if sign == "<=":
                b[1] = min(b[1], value)
            else:
                b[0] = max(b[0], value)
        found.add(tuple(sorted((STATISTICS[f], low, high) for f, (low, high) in bounds.items())))
    return found


def condition(rule: Rule) -> Column:
    parts = [F.col(name) > low for name, low, _ in rule if low > float("-inf")] + [F.col(name) <= high for name, _, high in rule if high < float("inf")]
    return reduce(lambda a, b: a & b, parts)


def fit_rules(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules from ``rows`` (the statistics and ``label`` 0/1).

    With fewer than two classes there is nothing to tell apart: no rules, and the intercept gives the
    smoothed share of label 1.
    """
    import math

    n, ones = rows.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if ones in (0, n):
        return math.log((ones + 1) / (n - ones + 1)), []
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, labelCol="label", featuresCol="statistics", featureSubsetStrategy="onethird", seed=7, maxBins=64, minInstancesPerNode=2)
    model = forest.fit(VectorAssembler(inputCols=STATISTICS, outputCol="statistics").transform(rows))
    rules = sorted(paths_of(model.toDebugString))
    if not rules:
        return math.log((ones + 1) / (n - ones + 1)), []
    held = rows.select("label", array_to_vector(F.array(*(condition(r).cast("double") for r in rules))).alias("rules"))
    lasso = LogisticRegression(labelCol="label", featuresCol="rules", elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=100).fit(held)
    return float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, lasso.coefficients, strict=True) if w]


def compiled(intercept: float, rules: list[tuple[Rule, float]]) -> Column:
    """Score of a row of statistics as one expression."""
    total = reduce(lambda a, b: a + b, (F.when(condition(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in rules), F.lit(intercept))
    return 1 / (1 + F.exp(-total))


def bounded(labelled: DataFrame, at_most: int, key: str = "doc_id") -> DataFrame:
    """``labelled`` thinned by a hash of ``key`` to about ``at_most`` rows."""
    n = labelled.count()
    return labelled if n <= at_most else labelled.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(at_most / n * (1 << 30)))


def learnable(labels: DataFrame, label: str) -> DataFrame:
    """One label for each id; the smaller of contradicting ones, none where id or label is null."""
    return labels.where(labels["doc_id"].isNotNull() & labels[label].isNotNull()).groupBy(labels["doc_id"].cast("bigint").alias("doc_id")).agg(F.min(labels[label]).cast("int").alias("label"))


def score_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, text_hash, held_out, score, predicted`` for every row of ``docs``.

    Labels are learned from rows whose crc32 of the id is not divisible by five. A null text is
    empty; an empty text has zero statistics and is scored like any other. Repeated rows each get a
    row, a null id is scored, other columns are ignored, no rows give no rows.
    """
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_hash(docs["text"]).alias("text_hash"), bucket_of(docs["doc_id"], 5).alias("fold"), text_of(docs).alias("text"))
    kinds = ", ".join(f"{s} double" for s in STATISTICS)
    measured = materialize(rows.mapInArrow(_measured, f"doc_id bigint, text_hash bigint, fold bigint, {kinds}"), "statistics")
    train = materialize(bounded(measured.where("fold <> 0").join(learnable(labels, "quality"), "doc_id"), fit_rows).select("label", *STATISTICS), "quality_rows")
    score = compiled(*fit_rules(train))
    return measured.select("doc_id", "text_hash", (F.col("fold") == 0).alias("held_out"), score.alias("score")).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
