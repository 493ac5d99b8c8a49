"""Projection, filter and cleaning operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.functions.codes import DUAL_PREFIXES, REPORT_CODES


def clean_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().strip('"') for c in df.columns])


def standardise_key(df: DataFrame, key: str) -> DataFrame:
    """Key as trimmed text; rows without a key are dropped."""
    trimmed = F.trim(F.col(key).cast("string"))
    return df.withColumn(key, trimmed).filter(F.length(key) > 0)


def drop_all_null_rows(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Drop rows with no value outside ``keys``."""
    keys = set(keys)
    return df.na.drop(how="all", subset=[c for c in df.columns if c not in keys])


def drop_any_null_rows(df: DataFrame, subset: Iterable[str] | None = None) -> DataFrame:
    return df.na.drop(how="any", subset=list(subset) if subset is not None else None)


def _pick(df: DataFrame, keys: list[str], order: list[Column], last: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest]) if rest else F.struct(F.lit(1).alias("_"))
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    pick = F.max_by if last else F.min_by
    # An aggregate, not row_number: copies of a key meet pairwise on the map side first, so
    # a key that holds a large share of the rows never has to be sorted in one task.
    return (
        df.groupBy(*keys)
        .agg(pick(row, rank).alias("_row"))
        .select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns])
    )


def dedup_keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``, which must be total for a repeatable result."""
    return _pick(df, keys, order, last=False)


def dedup_keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return _pick(df, keys, order, last=True)


def non_null_keys(df: DataFrame, *keys: str) -> DataFrame:
    for key in keys:
        df = df.filter(F.col(key).isNotNull())
    return df


def numeric_ids(df: DataFrame, key: str = "id") -> DataFrame:
    return df.filter(S.is_digits(key))


def non_numeric_ids(df: DataFrame, key: str = "id") -> DataFrame:
    return df.filter(F.col(key).isNotNull() & ~S.is_digits(key))


def coerce_types(df: DataFrame, texts: Iterable[str], dates: Iterable[str]) -> DataFrame:
    """Text columns stay text, ``dates`` are parsed, everything else becomes a double."""
    texts, dates = set(texts), set(dates)

    def typed(name: str, dtype: str) -> Column:
        c = F.col(f"`{name}`")
        if name in texts:
            return c.cast("string")
        if name in dates:
            return c if dtype == "date" else S.to_day(c)
        return S.to_number(c) if dtype == "string" else c.cast("double")

    return df.select(*[typed(n, t).alias(n) for n, t in df.dtypes])


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def coalesce_dual_codes(df: DataFrame) -> DataFrame:
    """Where an item is reported twice, prefer the domestic value and drop the other column."""
    domestic, consolidated = DUAL_PREFIXES
    present = set(df.columns)
    out = []
    for c in df.columns:
        code = c[len(domestic):]
        if c.startswith(domestic) and consolidated + code in present:
            out.append(F.coalesce(F.col(c), F.col(consolidated + code)).alias(c))
        elif not (c.startswith(consolidated) and domestic + code in present):
            out.append(F.col(c))
    return df.select(*out)


def rename_codes(df: DataFrame, names: dict[str, str] = REPORT_CODES) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def select_present(df: DataFrame, columns: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """Keep the wanted columns that exist; also report those that do not."""
    wanted = list(dict.fromkeys(columns))
    present = [c for c in wanted if c in df.columns]
    return df.select(*present), [c for c in wanted if c not in df.columns]


def date_range(df: DataFrame, begin: str | None, end: str | None, date: str = "date") -> DataFrame:
    if begin is not None:
        df = df.filter(F.col(date) >= F.lit(begin).cast("date"))
    if end is not None:
        df = df.filter(F.col(date) <= F.lit(end).cast("date"))
    return df


def one_year(df: DataFrame, year: int, date: str = "date") -> DataFrame:
    """Rows of a calendar year, as a range so that it reaches the scan."""
    return df.filter((F.col(date) >= F.lit(f"{year}-01-01").cast("date")) & (F.col(date) <= F.lit(f"{year}-12-31").cast("date")))


def fill_constant(df: DataFrame, value: str, columns: Iterable[str]) -> DataFrame:
    """Display marker for missing cells."""
    columns = set(columns)
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(value)).alias(c) if c in columns else F.col(c) for c in df.columns])


def net_flow(df: DataFrame, gross: str = "total_charge_offs", back: str = "total_recoveries", name: str = "net_charge_offs") -> DataFrame:
    return df.withColumn(name, F.col(gross) - F.col(back))


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Stack frames on the union of their columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
