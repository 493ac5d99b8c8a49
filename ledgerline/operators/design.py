"""Leak-free design matrices: split, label, lags, scaling and encoding."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.config import PanelConfig
from ledgerline.functions import scalars as S
from ledgerline.operators import preprocess
from ledgerline.operators.preprocess import EPSILON
from ledgerline.operators.sample import smallest_keys
from ledgerline.operators.windows import ar_lags, by_entity, feature_lags, lead_target
from ledgerline.session import materialize

TRAIN, TEST = "train", "test"
ENTITY = "bank_id"  # the category of entity effects


def date_cut(df: DataFrame, test_split: float | str) -> Column:
    """Last train date: before the last ceil(n * share) distinct dates, or a given date.

    NULL (which leaves both splits empty) when either split would have no date.
    """
    dates = F.sort_array(F.collect_set("date"))
    if isinstance(test_split, str):
        day = F.lit(test_split).cast("date")
        cut = F.when((day >= F.min("date")) & (day < F.max("date")), day)
    else:
        n = F.size(dates)
        train = n - F.greatest(F.ceil(n * F.lit(float(test_split))).cast("int"), F.lit(1))
        cut = F.when(train > 0, F.get(dates, train - 1))
    return df.agg(cut.alias("cut")).scalar()


def split_by_date(df: DataFrame, test_split: float | str) -> DataFrame:
    cut = date_cut(df, test_split)
    return df.withColumn("split", F.when(F.col("date") <= cut, F.lit(TRAIN)).when(F.col("date") > cut, F.lit(TEST))).filter(
        F.col("split").isNotNull()
    )


def split_by_entity(df: DataFrame, test_split: float, seed: int = 42) -> DataFrame:
    """ceil(n * share) pseudo-random entities form the test split."""
    ids = materialize(df.select("id").distinct().withColumn("_key", S.random_key("id", seed)), "entity-keys")
    test = smallest_keys(ids, "_key", lambda n: F.ceil(n * F.lit(float(test_split))))
    marked = df.join(test.withColumn("_test", F.lit(True)), "id", "left")
    return marked.withColumn("split", F.when(F.col("_test"), F.lit(TEST)).otherwise(F.lit(TRAIN))).drop("_test")


def standard_scale(df: DataFrame, columns: Sequence[str], prefix: str = "num__") -> DataFrame:
    """(x - mean) / population deviation, fitted on the train rows; constants only centred.

    All statistics come from one aggregate over the train rows, used as a scalar subquery.
    """
    # Wide matrices have hundreds of columns; SQL text keeps building their plan cheap.
    noise = "count(`{c}`) * {e} * var_pop(`{c}`) + pow(count(`{c}`) * avg(`{c}`) * {e}, 2)"
    spread = f"if(var_pop(`{{c}}`) <= {noise}, 1D, stddev_pop(`{{c}}`))"
    pairs = ", ".join(f"'m{i}', avg(`{c}`), 's{i}', {spread.format(c=c, e=f'{EPSILON}D')}" for i, c in enumerate(columns))
    train = df.filter(F.col("split") == TRAIN)
    fitted = df.withColumn("_fit", train.agg(F.expr(f"named_struct({pairs})").alias("_fit")).scalar())
    rest = [f"`{c}`" for c in df.columns if c not in columns]
    return fitted.selectExpr(*rest, *[f"(`{c}` - _fit.m{i}) / _fit.s{i} as `{prefix}{c}`" for i, c in enumerate(columns)])


def train_levels(df: DataFrame, column: str) -> list[str]:
    """Sorted train levels of a category that gets a column for each, such as the quarter of the year."""
    levels = df.filter((F.col("split") == TRAIN) & F.col(column).isNotNull()).select(column).distinct()
    return sorted(r[0] for r in levels.collect())


def one_hot(df: DataFrame, column: str, levels: Sequence[str], prefix: str = "cat__") -> DataFrame:
    """One 0/1 column per train level; a level unseen in training is all zeros."""
    hot = {f"{prefix}{column}_{v}": F.when(F.col(column) == v, 1.0).otherwise(0.0) for v in levels}
    return df.withColumns(hot).drop(column)


def one_hot_vector(df: DataFrame, column: str, prefix: str = "cat__") -> DataFrame:
    """All train levels as one sparse vector column, whatever their number; an unseen level is all zeros."""
    return preprocess.level_encoder(df.filter(F.col("split") == TRAIN), column, f"{prefix}{column}").transform(df).drop("_index", column)


def quarter_effect(date: str = "date") -> Column:
    return F.concat(F.lit("quarter_"), F.quarter(date))


def entity_effect(id_col: str = "id") -> Column:
    return F.concat(F.lit("bank_id_"), F.col(id_col).cast("string"))


def horizon_dataset(panel: DataFrame, target: str, horizon: int, cfg: PanelConfig, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """Unscaled design rows of one target and horizon: keys, ``split``, ``label`` and features.

    All offsets share one window over the entity, so the plan has a single shuffle of the panel.
    """
    base, ar_names = _with_own_lags(panel, target, cfg.lags if cfg.include_lags else 0, numeric, categorical)
    if cfg.split_dimension == "date":
        base = split_by_date(base, cfg.test_split)
    else:
        base = split_by_entity(base, float(cfg.test_split), cfg.seed)
    base = lead_target(base, target, horizon)
    base, lag_names = feature_lags(base, numeric, cfg.lags)
    features = [*categorical, *numeric, *lag_names, *ar_names]
    return base.select("id", "date", "split", "label", *sorted(features)).na.drop(how="any")


def _with_own_lags(panel: DataFrame, target: str, lags: int, numeric: Sequence[str], categorical: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The columns of a design with the target's own lags, where these and the target are known."""
    base = panel.select("id", "date", *dict.fromkeys([target, *numeric, *categorical]))
    base, ar_names = ar_lags(base, target, lags)
    return base.na.drop(how="any", subset=[target, *ar_names]), ar_names


def scoring_rows(panel: DataFrame, target: str, horizon: int, cfg: PanelConfig, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """Unscaled design rows of a panel no split is made of: keys, ``label`` and features.

    The features of a row are those of :func:`horizon_dataset`; the label is the target ``horizon`` rows
    ahead and NULL where that is not known yet, which is where a forecast is wanted.
    """
    base, ar_names = _with_own_lags(panel, target, cfg.lags if cfg.include_lags else 0, numeric, categorical)
    base = base.withColumn("label", F.lead(target, horizon).over(by_entity()))
    base, lag_names = feature_lags(base, numeric, cfg.lags)
    features = sorted([*categorical, *numeric, *lag_names, *ar_names])
    return base.select("id", "date", "label", *features).na.drop(how="any", subset=features)


def scale_and_encode(dataset: DataFrame, categorical: Sequence[str] = ()) -> DataFrame:
    """Scaled numeric and encoded categorical columns next to the keys, split and label."""
    return preprocess.fit(dataset, categorical).apply(dataset)


def feature_columns(matrix: DataFrame) -> list[str]:
    return [c for c in matrix.columns if re.match(r"(num|cat)__", c)]


def expanding_folds(train: DataFrame, k: int) -> DataFrame:
    """Date bounds of ``k`` expanding folds: train up to ``train_end``, test until ``test_end``.

    Each test block has n // (k + 1) of the n distinct dates and follows all its train dates.
    """
    dates = train.agg(F.sort_array(F.collect_set("date")).alias("d"))
    n = F.size("d")
    block = F.floor(n / F.lit(k + 1)).cast("int")
    first = n - (F.lit(k) - F.col("i")) * block
    folds = dates.filter(block > 0).select("d", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"))
    return folds.select(
        (F.col("i") + 1).alias("fold"),
        F.get("d", first - 1).alias("train_end"),
        F.get("d", first).alias("test_start"),
        F.get("d", first + block - 1).alias("test_end"),
    )


def fold_rows(train: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of every fold with their role; a row appears once per fold it belongs to."""
    per_fold = folds.agg(F.collect_list(F.struct("fold", "train_end", "test_start", "test_end"))).scalar()
    d = F.col("date")
    marked = train.withColumn("_folds", per_fold).select(*train.columns, F.inline("_folds"))
    role = F.when(d <= F.col("train_end"), F.lit(TRAIN)).when(d.between(F.col("test_start"), F.col("test_end")), F.lit(TEST))
    return marked.withColumn("role", role).filter(F.col("role").isNotNull()).drop("train_end", "test_start", "test_end")
