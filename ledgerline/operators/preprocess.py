"""Scaling and encoding fitted on train rows, stored beside the models and applied to rows that come later."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("id", "date", "split", "label")
# Doubles carry about 16 digits; a spread below this share of the mean is rounding noise.
EPSILON = 2.220446049250313e-16
#: A category with more levels than this becomes one sparse vector instead of a column for each level.
WIDE_LEVELS = 64
_SCALING = "position int, column string, mean double, deviation double"
_LEVELS = "category string, position int, level string"
_VECTORS = "category string"


def level_encoder(train: DataFrame, column: str, out: str) -> PipelineModel:
    """Encoder of all train levels as one sparse vector; a level unseen in training is all zeros."""
    index = StringIndexer(inputCol=column, outputCol="_index", handleInvalid="keep", stringOrderType="alphabetAsc")
    indexed = index.fit(train.filter(F.col(column).isNotNull()))
    # The last index stands for levels unseen in training and is the one dropped.
    return PipelineModel([indexed, OneHotEncoder(inputCol="_index", outputCol=out).fit(indexed.transform(train))])


@dataclass(frozen=True)
class Preprocessing:
    """What train rows say about columns: two numbers for each numeric one, the levels of each category.

    A category of up to ``WIDE_LEVELS`` levels gets a 0/1 column a level, one with more (such as the
    entities) a sparse vector. A level unseen in training is all zeros.
    """

    scaling: tuple[tuple[str, float, float], ...]
    levels: dict[str, tuple[str, ...]] = field(default_factory=dict)
    vectors: dict[str, PipelineModel] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` with scaled ``num__`` and encoded ``cat__`` columns in place of the raw ones; other columns stay."""
        scaled = {c for c, _, _ in self.scaling}
        rest = [f"`{c}`" for c in df.columns if c not in scaled]
        out = df.selectExpr(*rest, *[f"(`{c}` - {m!r}D) / {s!r}D as `num__{c}`" for c, m, s in self.scaling])
        for c, levels in self.levels.items():
            out = out.withColumns({f"cat__{c}_{v}": F.when(F.col(c) == v, 1.0).otherwise(0.0) for v in levels}).drop(c)
        for c, encoder in self.vectors.items():
            out = encoder.transform(out).drop("_index", c)
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """One row a fitted column or level: kind, column, level, mean, deviation."""
        rows = [("numeric", c, None, m, s) for c, m, s in self.scaling] + [("category", c, v, None, None) for c, levels in self.levels.items() for v in levels]
        return spark.createDataFrame(rows, "kind string, column string, level string, mean double, deviation double")

    def save(self, path: str, spark: SparkSession) -> None:
        """Store the fitted tables below ``path``; :func:`load` reads them back."""
        scaling = [(i, *row) for i, row in enumerate(self.scaling)]
        levels = [(c, i, v) for c, found in self.levels.items() for i, v in enumerate(found)]
        # a category without levels is remembered by a row without one
        levels += [(c, -1, None) for c in self.levels]
        for name, rows, schema in (("scaling", scaling, _SCALING), ("levels", levels, _LEVELS), ("vectors", [(c,) for c in self.vectors], _VECTORS)):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")
        for c, encoder in self.vectors.items():
            encoder.write().overwrite().save(f"{path}/encoders/{c}")


def fit(rows: DataFrame, categorical: Sequence[str] = (), train: str = "train") -> Preprocessing:
    """Statistics of the train rows of a design table: every column but keys and categories is numeric.

    (x - mean) / population deviation; constants are only centred. The numbers of all columns come
    from one aggregate; the levels of a category are fetched only as far as they get columns.
    """
    fitted_on = rows.filter(F.col("split") == train)
    numeric = [c for c in rows.columns if c not in KEYS and c not in categorical]
    noise = "count(`{c}`) * {e} * var_pop(`{c}`) + pow(count(`{c}`) * avg(`{c}`) * {e}, 2)"
    spread = f"if(var_pop(`{{c}}`) <= {noise}, 1D, stddev_pop(`{{c}}`))"
    found = fitted_on.selectExpr(*[s for i, c in enumerate(numeric) for s in (f"avg(`{c}`) as m{i}", f"{spread.format(c=c, e=f'{EPSILON}D')} as s{i}")] or ["1"]).first()
    scaling = tuple((c, found[f"m{i}"], found[f"s{i}"]) for i, c in enumerate(numeric)) if numeric else ()
    if any(m is None for _, m, _ in scaling):
        raise ValueError("a numeric column has no value in the train rows")
    levels, vectors = {}, {}
    for c in categorical:
        some = [r[0] for r in fitted_on.filter(F.col(c).isNotNull()).select(c).distinct().limit(WIDE_LEVELS + 1).collect()]
        if len(some) <= WIDE_LEVELS:
            levels[c] = tuple(sorted(some))
        else:
            vectors[c] = level_encoder(fitted_on, c, f"cat__{c}")
    return Preprocessing(scaling, levels, vectors)


def load(path: str, spark: SparkSession) -> Preprocessing:
    """Preprocessing stored by :meth:`Preprocessing.save`."""
    scaling = tuple((r.column, r["mean"], r.deviation) for r in spark.read.schema(_SCALING).parquet(f"{path}/scaling").orderBy("position").collect())
    levels: dict[str, list[str]] = {}
    for r in spark.read.schema(_LEVELS).parquet(f"{path}/levels").orderBy("category", "position").collect():
        levels.setdefault(r.category, [])
        if r.position >= 0:
            levels[r.category].append(r.level)
    vectors = [r.category for r in spark.read.schema(_VECTORS).parquet(f"{path}/vectors").collect()]
    return Preprocessing(scaling, {c: tuple(v) for c, v in levels.items()}, {c: PipelineModel.load(f"{path}/encoders/{c}") for c in vectors})
