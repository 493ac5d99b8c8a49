"""Aggregation and profile operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.joins import checked_broadcast
from ledgerline.operators.linear import pairwise_moments
from ledgerline.operators.quantiles import grouped_quantiles
from ledgerline.operators.windows import quarter_grid, scalar_struct
from ledgerline.session import materialize

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def system_totals(df: DataFrame, columns: Iterable[str], date: str = "date") -> DataFrame:
    """Sums per date; NULLs are skipped and an all-NULL date sums to 0."""
    return df.groupBy(date).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in columns])


def date_mean(df: DataFrame, columns: Iterable[str], date: str = "date") -> DataFrame:
    return df.groupBy(date).agg(*[F.avg(c).alias(c) for c in columns])


def date_profile(df: DataFrame, column: str, date: str = "date") -> DataFrame:
    """Mean, median and quartiles of a variable per date; a date without a value has none.

    ``df`` is read once, to store the two columns; the mean comes from the first counting pass.
    """
    stored = materialize(df.select(date, F.col(column).cast("double").alias(column)), "profile")
    stats = grouped_quantiles(stored, [date], column, QUARTILES, moments=True).select(date, "mean", *QUARTILES)
    return stored.select(date).distinct().join(checked_broadcast(stats), date, "left")


def quantile_bands(df: DataFrame, columns: Sequence[str], date: str = "date") -> DataFrame:
    """Quartiles per date of several columns side by side, named ``{column}_q25`` and so on; reads ``df`` once."""
    long = unpivot(_stored(df, [date], columns), [date], columns)
    bands = grouped_quantiles(long, [date, "variable"], "value", QUARTILES)
    cells = [
        F.max(F.when(F.col("variable") == c, F.col(q))).alias(f"{c}_{q}") for c in columns for q in QUARTILES
    ]
    return bands.groupBy(date).agg(*cells)


def _stored(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The columns a statistic needs, stored, so that its passes do not compute them again."""
    return materialize(df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]), "statistic")


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    doubles = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot(list(keys), list(columns), "variable", "value")


def describe_by_variable(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std (n-1), min, quartiles and max per variable that has a value.

    ``df`` is read once, to store the columns; everything but the quartiles comes from the first
    of the counting passes.
    """
    long = unpivot(_stored(df, [], columns), [], columns)
    stats = grouped_quantiles(long, ["variable"], "value", QUARTILES, moments=True)
    return stats.select("variable", F.col("n").alias("count"), "mean", "std", "min", *QUARTILES, "max")


def correlation_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of all pairs over the rows where both are known, as (var_a, var_b, r).

    The rows are read twice: for the means, about which nothing is lost to rounding, and for the
    cross products of values and of marks of known values, which hold the statistics of all pairs in
    one matrix product a batch. What comes to the driver depends on the columns only. A pair without
    two rows or without spread has no correlation, a variable with spread 1 with itself.
    """
    columns = list(columns)
    moments = pairwise_moments(df, columns)
    r = moments.correlations()
    rows = [(a, b, None if np.isnan(r[i, j]) else float(r[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "var_a string, var_b string, r double")


def distinct_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Number of distinct values of each column, NULL not among them.

    Each column is read by itself (pruned to that column) and reduced to its keys on the map side; several
    distinct counts in one aggregate would repeat every row for each of them.
    """
    counts = [df.select(c).filter(F.col(c).isNotNull()).distinct().agg(F.count(F.lit(1))).scalar().alias(f"n_{c}") for c in columns]
    return df.sparkSession.range(1).select(*counts)


def average_dates_per_entity(df: DataFrame) -> DataFrame:
    per_id = df.groupBy("id").agg(F.count_distinct("date").alias("n"))
    return per_id.agg(F.avg("n").alias("avg_dates_per_entity"))


def global_moments(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    columns = list(columns)
    return df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def global_quantiles(df: DataFrame, columns: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Quantiles of several columns, one row a column; ``df`` is read once, to store the columns."""
    return grouped_quantiles(unpivot(_stored(df, [], columns), [], columns), ["variable"], "value", probs)


def multi_event_entities(df: DataFrame, event: str = "failed") -> DataFrame:
    return df.groupBy("id").agg(F.sum(event).alias("events")).filter(F.col("events") > 1)


def observations_per_date(df: DataFrame, column: str) -> DataFrame:
    """Per quarter of the full grid: entities without a value.

    Equal to counting NULLs on the entity x quarter grid, computed as entities minus known values.
    """
    ids = scalar_struct(df, n=F.count_distinct("id"))["n"]
    known = df.groupBy("date").agg(F.count(column).alias("known"))
    bounds = df.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    grid = bounds.select(F.explode(F.sequence("lo", "hi", F.expr("interval 3 months"))).alias("date"))
    return grid.join(known, "date", "left").select("date", (ids - F.coalesce(F.col("known"), F.lit(0))).alias("missing"))


def complete_entities(df: DataFrame, column: str) -> DataFrame:
    """Entities in total, with a value in every quarter, without, and the complete share in percent."""
    quarters = F.size(quarter_grid(df))
    per_id = df.groupBy("id").agg(F.count(column).alias("known"))
    full = F.sum(F.when(F.col("known") == quarters, 1).otherwise(0))
    n = F.count("*")
    return per_id.agg(
        n.alias("entities"),
        full.alias("complete"),
        (n - full).alias("incomplete"),
        (full / n * 100).alias("complete_pct"),
        (n * F.max(quarters) - F.sum("known")).alias("missing_cells"),
    )


def missingness_report(df: DataFrame, column: str, min_observations: int) -> DataFrame:
    """Completeness of the panel and the entities a minimum of observations would remove."""
    few = df.groupBy("id").agg(F.count(column).alias("known")).agg(F.count_if(F.col("known") < min_observations))
    return complete_entities(df, column).withColumn("removed_entities", few.scalar())


def pivot_mean(df: DataFrame, rows: Sequence[str], column: str, value: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(*rows).pivot(column, list(values)).agg(F.avg(value))


def pivot_first(df: DataFrame, row: str, keys: Sequence[str], value: str, values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First text per (row, key combination), key combinations as columns."""
    keyed = df.withColumn("_key", F.concat_ws("|", *keys))
    rank = F.struct(*order)
    cells = [F.min_by(F.when(F.col("_key") == v, F.col(value)), F.when(F.col("_key") == v, rank)).alias(v) for v in values]
    return keyed.groupBy(row).agg(*cells)


def best_per_group(df: DataFrame, group: str, metric: str) -> DataFrame:
    return df.groupBy(group).agg(F.min(metric).alias(metric)).orderBy(metric, group)


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins between the extremes; the maximum belongs to the last bin."""
    b = scalar_struct(df, lo=F.min(column), hi=F.max(column))
    width = (b["hi"] - b["lo"]) / bins
    x = F.col(column)
    index = F.when(b["hi"] > b["lo"], F.floor(F.try_divide(x - b["lo"], b["hi"] - b["lo"]) * bins)).otherwise(0)
    binned = df.filter(x.isNotNull()).select(F.least(index, F.lit(bins - 1)).cast("int").alias("bin"), b["lo"].alias("_lo"), width.alias("_w"))
    return (
        binned.groupBy("bin", "_lo", "_w")
        .agg(F.count("*").alias("n"))
        .select("bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_start"), "n")
    )


def top_n_importance(df: DataFrame, n: int, group: Sequence[str] = ("model",), value: str = "importance") -> DataFrame:
    """The ``n`` features with the largest absolute importance per model (a report has few features)."""
    w = Window.partitionBy(*group).orderBy(F.abs(F.col(value)).desc(), "feature")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def report_sort(df: DataFrame, column: str, order: Sequence[str], then: Sequence[str]) -> DataFrame:
    """Rows in a given order of ``column`` values; other values are dropped."""
    ranks = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(order)], f"{column} string, report_rank int")
    return df.join(F.broadcast(ranks), column).orderBy("report_rank", *then)
