"""Macro, industry and index series: quarterly tables and their transforms."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators.joins import series_wide
from ledgerline.operators.windows import resample_first

# Macro series and how each is transformed.
MACRO_SERIES = (
    "gdp", "tbill_3m", "tbill_1y", "tbill_10y", "tbill_30y", "cpi",
    "cons_sentiment", "unemployment", "corp_bond_spread", "household_delinq", "vix",
)
GROWTH_SERIES = ("gdp", "cpi", "cons_sentiment", "vix")
PERCENT_SERIES = (
    "tbill_3m", "tbill_1y", "tbill_10y", "tbill_30y", "unemployment", "corp_bond_spread", "household_delinq", "cons_sentiment",
)
DIFF_SERIES = ("tbill_3m", "tbill_1y", "tbill_10y", "tbill_30y", "unemployment", "household_delinq", "corp_bond_spread")
SPREADS = {"spread_10y_3m": ("tbill_10y", "tbill_3m"), "spread_10y_1y": ("tbill_10y", "tbill_1y")}
GROWTH_PERIODS = {"_qoq": 1, "_yoy": 4}


def long_changes(long: DataFrame, series: str = "series", date: str = "date", value: str = "value") -> DataFrame:
    """Difference, quarterly and yearly growth of every series of a long table."""
    w = Window.partitionBy(series).orderBy(date)
    filled = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = long.withColumns({"diff": F.col(value) - F.lag(value).over(w), "_ff": filled})
    growth = {n.strip("_"): S.ratio("_ff", F.lag("_ff", k).over(w)) - 1 for n, k in GROWTH_PERIODS.items()}
    return out.withColumns(growth).drop("_ff")


def _as_long(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    return wide.select("date", *[F.col(n).cast("double").alias(n) for n in names]).unpivot("date", list(names), "series", "value")


def transform_wide(wide: DataFrame, growth: Iterable[str], diffs: Iterable[str]) -> DataFrame:
    """Append ``_qoq``/``_yoy`` and ``_diff`` columns to a table with a row per quarter.

    The offsets run over the long form, where each series is its own window group; a window over
    the wide table would have no partitioning.
    """
    growth, diffs = [c for c in growth if c in wide.columns], [c for c in diffs if c in wide.columns]
    names = list(dict.fromkeys([*growth, *diffs]))
    changed = long_changes(_as_long(wide, names))
    cells = []
    for c in growth:
        cells += [F.max(F.when(F.col("series") == c, F.col(k.strip("_")))).alias(f"{c}{k}") for k in GROWTH_PERIODS]
    cells += [F.max(F.when(F.col("series") == c, F.col("diff"))).alias(f"{c}_diff") for c in diffs]
    return wide.join(changed.groupBy("date").agg(*cells), "date")


def macro_table(long: DataFrame) -> DataFrame:
    """Quarterly macro table from long observations (series, date, value), on the dates of ``gdp``.

    Growth of a series is taken on its level as published; percent series become fractions before
    they are differenced.
    """
    wide = series_wide(long, "gdp", MACRO_SERIES)
    with_growth = transform_wide(wide, GROWTH_SERIES, [])
    fractions = with_growth.withColumns({c: F.col(c) / 100 for c in PERCENT_SERIES})
    spread = fractions.withColumns({n: F.col(a) - F.col(b) for n, (a, b) in SPREADS.items()})
    return transform_wide(spread, [], [*DIFF_SERIES, *SPREADS])


def industry_table(long: DataFrame, spine: str, names: Sequence[str], ratios: Sequence[str], growth: Sequence[str], diffs: Sequence[str], assets: str = "total_assets") -> DataFrame:
    """Industry aggregates: ratios to total assets, growth and differences."""
    wide = series_wide(long, spine, names)
    scaled = wide.withColumns({f"{c}_to_assets": S.ratio(c, assets) for c in ratios if c in wide.columns})
    return transform_wide(scaled, growth, diffs)


def index_table(daily: DataFrame, close: str, day: str = "day", name: str = "sp500") -> DataFrame:
    """Quarterly index level (first close of the previous quarter's span) with growth columns."""
    return transform_wide(resample_first(daily, close, day, name), [name], [])
