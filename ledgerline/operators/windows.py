"""Order-dependent operators on series and panels.

Offsets are positional within the ordered group, as in the study design: a missing quarter is
not a gap. Panels hold one row per (id, date), so a window group is as long as the calendar.
Every operator uses the same partitioning and ordering; chained calls share one shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S


def by_entity(id_col: str = "id", date_col: str = "date"):
    return Window.partitionBy(id_col).orderBy(date_col)


def scalar_struct(df: DataFrame, **aggs: Column) -> Column:
    """One-row aggregate as a scalar subquery: no join, nothing collected."""
    return df.agg(F.struct(*[v.alias(k) for k, v in aggs.items()]).alias("_stats")).scalar()


def _shifted(df: DataFrame, columns: list[str], offsets: Iterable[int], window, name: str) -> DataFrame:
    """Structs ``{name}{k}`` with all ``columns`` k rows back.

    One window expression per offset instead of one per column and offset: wide panels would
    otherwise carry hundreds of them.
    """
    packed = F.struct(*[F.col(c) for c in columns])
    return df.withColumns({f"{name}{k}": F.lag(packed, k).over(window) for k in offsets})


def diff(df: DataFrame, columns: Iterable[str], group: str, date: str = "date", suffix: str = "_diff") -> DataFrame:
    columns = list(columns)
    back = _shifted(df, columns, [1], Window.partitionBy(group).orderBy(date), "_back")
    return back.withColumns({f"{c}{suffix}": F.col(c) - F.col(f"_back1.`{c}`") for c in columns}).drop("_back1")


def pct_change(df: DataFrame, columns: Iterable[str], group: str, date: str = "date", periods: dict[str, int] | None = None) -> DataFrame:
    """Growth against the value ``n`` rows back, with NULLs filled forward before the ratio."""
    columns = list(columns)
    periods = periods or {"_qoq": 1}
    w = Window.partitionBy(group).orderBy(date)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = df.withColumns({f"_ff_{c}": F.last(c, ignorenulls=True).over(running) for c in columns})
    back = _shifted(filled, [f"_ff_{c}" for c in columns], periods.values(), w, "_back")
    growth = {
        f"{c}{suffix}": S.ratio(f"_ff_{c}", f"_back{n}.`_ff_{c}`") - 1 for c in columns for suffix, n in periods.items()
    }
    return back.withColumns(growth).drop(*[f"_ff_{c}" for c in columns], *[f"_back{n}" for n in periods.values()])


def panel_changes(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``{c}_diff`` and ``{c}_qoq`` per entity for every column."""
    columns = [c for c in columns if c in df.columns]
    return pct_change(diff(df, columns, "id"), columns, "id")


def ytd_to_quarterly(df: DataFrame, flows: Iterable[str], id_col: str = "id", date_col: str = "date") -> DataFrame:
    """Year-to-date flows to quarterly flows; the first report of a year keeps its value."""
    keyed = df.withColumn("_year", F.year(date_col))
    w = Window.partitionBy(id_col).orderBy(date_col)
    same_year = F.lag("_year").over(w) == F.col("_year")
    out = keyed.withColumns(
        {c: F.coalesce(F.when(same_year, F.col(c) - F.lag(c).over(w)), F.col(c)) for c in flows}
    )
    return out.drop("_year")


def gap_fill_single(df: DataFrame, value: str, id_col: str = "id", date_col: str = "date", flag: str = "gap_filled") -> DataFrame:
    """Fill a quarter whose two neighbours have a value with the earlier one; drop other gaps.

    Equal to filling on the full entity x quarter grid, but the grid is never built: a missing
    row shows as a distance of two quarters between neighbours and is added next to its
    predecessor, so the cost follows the rows that exist.
    """
    w = by_entity(id_col, date_col)
    v, d = F.col(value), F.col(date_col)
    rest = [c for c in df.columns if c not in (id_col, date_col, value)]
    near = df.filter(d == S.quarter_start(d)).withColumns(
        {
            "_pv": F.lag(value).over(w),
            "_pd": F.lag(date_col).over(w),
            "_nv": F.lead(value).over(w),
            "_nd": F.lead(date_col).over(w),
        }
    )
    fillable = (
        v.isNull() & F.col("_pv").isNotNull() & F.col("_nv").isNotNull()
        & (F.col("_pd") == F.add_months(d, -3)) & (F.col("_nd") == F.add_months(d, 3))
    )
    absent_next = v.isNotNull() & F.col("_nv").isNotNull() & (F.col("_nd") == F.add_months(d, 6))
    rows = near.withColumn("_fill", fillable).withColumn(
        "_new", F.explode(F.when(absent_next, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    )
    new = F.col("_new")
    return rows.select(
        F.col(id_col),
        F.when(new, F.add_months(d, 3)).otherwise(d).alias(date_col),
        F.when(F.col("_fill"), F.col("_pv")).otherwise(v).alias(value),
        *[F.when(~new, F.col(c)).alias(c) for c in rest],
        (new | F.col("_fill")).alias(flag),
    ).filter(F.col(value).isNotNull())


def fill_summary(filled: DataFrame, date_col: str = "date", flag: str = "gap_filled") -> DataFrame:
    """Number of filled cells per date."""
    return filled.filter(F.col(flag)).groupBy(date_col).agg(F.count("*").alias("count_filled"))


def quarter_grid(df: DataFrame, date: str = "date") -> Column:
    """Array of all quarter starts between the first and last date of ``df``."""
    bounds = scalar_struct(df, lo=F.min(date), hi=F.max(date))
    return F.sequence(bounds["lo"], bounds["hi"], F.expr("interval 3 months"))


def panel_spine(df: DataFrame, id_col: str = "id", date_col: str = "date") -> DataFrame:
    """All entities x all quarters between the first and last date; missing cells are NULL."""
    grid = df.select(id_col).distinct().select(id_col, F.explode(quarter_grid(df, date_col)).alias(date_col))
    return grid.join(df, [id_col, date_col], "left")


def ar_lags(df: DataFrame, target: str, lags: int) -> tuple[DataFrame, list[str]]:
    names = {f"{target}_ar_lag_{k}": k for k in range(1, lags + 1)}
    w = by_entity()
    return df.withColumns({n: F.lag(target, k).over(w) for n, k in names.items()}), list(names)


def feature_lags(df: DataFrame, features: Iterable[str], lags: int) -> tuple[DataFrame, list[str]]:
    """Lags over all rows of an entity.

    One pass serves both splits: with a date split every train row precedes the test rows of
    its entity, with an entity split the entities are disjoint, so no train row sees a test row.
    """
    features, offsets = list(features), range(1, lags + 1)
    names = {f"{f}_lag_{k}": f"_back{k}.`{f}`" for f in features for k in offsets}
    if not names:
        return df, []
    back = _shifted(df, features, offsets, by_entity(), "_back")
    own = [f"`{c}`" for c in df.columns]
    return back.selectExpr(*own, *[f"{source} as `{n}`" for n, source in names.items()]), list(names)


def lead_target(df: DataFrame, target: str, horizon: int, label: str = "label", split: str = "split") -> DataFrame:
    """Target ``horizon`` rows ahead within the entity's own split; NULL at the end of a split."""
    w = by_entity()
    ahead = F.lead(target, horizon).over(w)
    return df.withColumn(label, F.when(F.lead(split, horizon).over(w) == F.col(split), ahead))


def abs_change_filter(df: DataFrame, column: str, limit: float) -> DataFrame:
    """Drop rows whose change against the previous row exceeds ``limit``; no change counts as 0."""
    step = F.abs(F.col(column) - F.lag(column).over(by_entity()))
    return df.withColumn("_step", F.coalesce(step, F.lit(0.0))).filter(F.col("_step") <= limit).drop("_step")


def break_flags(df: DataFrame, column: str, threshold: float, flag: str = "is_structural_break") -> DataFrame:
    """1.0 where the change exceeds ``threshold`` standard deviations of all changes, else 0.0."""
    stepped = df.withColumn("_step", F.col(column) - F.lag(column).over(by_entity()))
    spread = scalar_struct(stepped, s=F.stddev_samp("_step"))["s"]
    hit = F.coalesce(F.abs(F.col("_step")) > F.lit(threshold) * spread, F.lit(False))
    return stepped.withColumn(flag, hit.cast("double")).drop("_step")


def back_adjust(df: DataFrame, column: str, flag: str = "is_structural_break") -> DataFrame:
    """Scale the values before each break to the level after it.

    A break only rescales earlier rows, so its own factor does not depend on other breaks and
    the compounded factor of a row is the product of the factors after it.
    """
    w = by_entity()
    prev = F.lag(column).over(w)
    factor = F.when((F.col(flag) == 1.0) & (prev != 0), S.ratio(column, prev))
    later = Window.partitionBy("id").orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_factor", factor)
        .withColumn(column, F.col(column) * F.coalesce(F.product("_factor").over(later), F.lit(1.0)))
        .drop("_factor")
    )


def resample_first(daily: DataFrame, value: str, day: str = "day", name: str | None = None) -> DataFrame:
    """First known value of each quarter, dated at the start of the next quarter."""
    known = daily.filter(F.col(value).isNotNull()).select(day, value, S.quarter_start(day).alias("_q"))
    firsts = known.groupBy("_q").agg(F.min_by(value, day).alias(name or value))
    bounds = daily.agg(S.quarter_start(F.min(day)).alias("lo"), S.quarter_start(F.max(day)).alias("hi"))
    grid = bounds.select(F.explode(F.sequence("lo", "hi", F.expr("interval 3 months"))).alias("_q"))
    return grid.join(firsts, "_q", "left").select(F.add_months("_q", 3).alias("date"), name or value)


def resample_mean(observations: DataFrame, series: str, value: str, day: str) -> DataFrame:
    """Quarterly average of every series of a long table (series, day, value)."""
    return observations.groupBy(F.col(series).alias("series"), S.quarter_start(day).alias("date")).agg(F.avg(value).alias("value"))
