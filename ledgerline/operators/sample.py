"""Sample rules: which entities and rows take part in a study."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.config import PanelConfig
from ledgerline.functions import scalars as S
from ledgerline.operators import clean
from ledgerline.operators.joins import BROADCAST_ROWS
from ledgerline.operators.aggregates import global_quantiles
from ledgerline.operators.quantiles import order_statistics
from ledgerline.operators.windows import abs_change_filter, scalar_struct


def _per_entity(df: DataFrame, stat, keep) -> DataFrame:
    # Same partitioning as the lag windows, so the rule costs no further shuffle and no join.
    w = Window.partitionBy("id")
    return df.withColumn("_stat", stat.over(w)).filter(keep(F.col("_stat"))).drop("_stat")


def min_observations(df: DataFrame, column: str, n: int) -> DataFrame:
    return _per_entity(df, F.count(column), lambda s: s >= n)


def min_ratio(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """Entities whose smallest value reaches the threshold."""
    return _per_entity(df, F.min(column), lambda s: s >= threshold)


def min_mean_size(df: DataFrame, column: str, threshold: float) -> DataFrame:
    return _per_entity(df, F.avg(column), lambda s: s >= threshold)


def _keep(df: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    return df.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, "id", "left_semi")


def largest_entities(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` entities with the largest mean; ties go to the smaller id.

    Entities without a mean come last, so they drop out only where there are more than ``n``.
    """
    means = df.groupBy("id").agg(F.avg(column).alias("_m"))
    return _keep(df, means.orderBy(F.col("_m").desc_nulls_last(), "id").limit(n).select("id"), n)


def smallest_keys(keys: DataFrame, rank_column: str, count) -> DataFrame:
    """The ``count(n)`` of ``n`` distinct keys with the smallest rank value, ties by key.

    The cut value is found by counting, so no task and not the driver ever holds the keys.
    """
    stats = order_statistics(keys, [], rank_column, lambda n: [count(n) - 1])
    cut = stats.select(F.struct(F.col("s0").alias("v"), count(F.col("n")).alias("k")).alias("_c")).scalar()
    below = keys.withColumn("_cut", cut).filter(F.col(rank_column) <= F.col("_cut.v"))
    tied = F.col(rank_column) == F.col("_cut.v")
    sure = below.agg(F.count(F.when(~tied, 1))).scalar()
    nth = F.row_number().over(Window.partitionBy(rank_column).orderBy("id"))
    ties = below.filter(tied).withColumn("_nth", nth).filter(F.col("_nth") <= F.col("_cut.k") - sure)
    return below.filter(~tied).select("id").unionByName(ties.select("id"))


def sample_entities(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` pseudo-random entities; the same for the same seed, whatever the partitioning."""
    ids = df.select("id").distinct()
    return _keep(df, ids.orderBy(S.random_key("id", seed), "id").limit(n), n)


def remove_outliers(df: DataFrame, targets: Sequence[str], threshold: float) -> DataFrame:
    """Keep \\|x - mean\\| / std < threshold or NULL, one target after the other.

    Each target's mean and deviation are taken over the rows the earlier targets left, so the
    passes depend on each other. Only the two numbers of a target come to the driver; as literals
    they keep the plan flat and reach the scan as a filter.
    """
    for target in targets:
        if target not in df.columns:
            continue
        mean, std = df.agg(F.avg(target), F.stddev_samp(target)).first()
        if not std or mean is None:
            continue
        z = F.abs((F.col(target) - F.lit(mean)) / F.lit(std))
        df = df.filter((z < threshold) | z.isNull())
    return df


def winsorize(df: DataFrame, columns: Iterable[str], lower: float, upper: float) -> DataFrame:
    """Limit columns to their own percentiles."""
    numeric = {n for n, t in df.dtypes if t in ("double", "float", "int", "bigint")}
    columns = [c for c in columns if c in numeric]
    if not columns:
        return df
    limits = global_quantiles(df, columns, {"lo": lower, "hi": upper})
    b = scalar_struct(
        limits,
        **{f"{c}_{e}": F.max(F.when(F.col("variable") == c, F.col(e))) for c in columns for e in ("lo", "hi")},
    )
    out = df.withColumn("_limits", b)
    return out.withColumns(
        {c: S.clip(c, F.col(f"_limits.`{c}_lo`"), F.col(f"_limits.`{c}_hi`")) for c in columns}
    ).drop("_limits")


def restrict_sample(df: DataFrame, cfg: PanelConfig, ratio_column: str = "deposit_ratio", size_column: str = "total_assets", rank_column: str = "log_total_assets") -> DataFrame:
    """All configured rules in their fixed order; later rules see only what earlier ones left."""
    out = clean.date_range(df, cfg.data_begin, cfg.data_end)
    if cfg.max_ratio_change is not None and ratio_column in out.columns:
        out = abs_change_filter(out, ratio_column, cfg.max_ratio_change)
    if cfg.min_mean_size is not None and size_column in out.columns:
        out = min_mean_size(out, size_column, cfg.min_mean_size)
    if cfg.min_ratio is not None and ratio_column in out.columns:
        out = min_ratio(out, ratio_column, cfg.min_ratio)
    if cfg.largest_entities is not None and rank_column in out.columns:
        out = largest_entities(out, rank_column, cfg.largest_entities)
    if cfg.sample_entities is not None:
        out = sample_entities(out, cfg.sample_entities, cfg.seed)
    return out
