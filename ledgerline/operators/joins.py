"""Join operators. Broadcast hints are given only behind a check of the row count."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators.clean import dedup_keep_last
from ledgerline.session import materialize

BROADCAST_ROWS = 50_000


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if it has at most ``max_rows`` rows, else leave the join to Spark.

    Meant for calendar tables (a row per quarter) and short lists. ``df`` is stored first, so what it is made
    from is read once: the count comes from the stored file. Beyond the limit the adaptive planner chooses and
    splits skewed keys.
    """
    stored = materialize(df, "small-side")
    return F.broadcast(stored) if stored.count() <= max_rows else stored


def macro_panel_join(panel: DataFrame, macro: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Panel rows on macro dates with the macro columns, plus the index columns where known."""
    out = panel.filter(F.col("id").isNotNull()).join(checked_broadcast(macro), "date")
    if index is not None:
        out = out.join(checked_broadcast(index), "date", "left")
    return out


def series_wide(long: DataFrame, spine: str, names: Sequence[str], series: str = "series", date: str = "date", value: str = "value") -> DataFrame:
    """Long series table to one row per date of the ``spine`` series, a column per series.

    One aggregate replaces the chain of left joins; dates the spine does not have are dropped.
    """
    cells = {n: F.max(F.when(F.col(series) == n, F.col(value))) for n in names}
    return (
        long.groupBy(date)
        .agg(F.max(F.when(F.col(series) == spine, F.lit(1))).alias("_on_spine"), *[c.alias(n) for n, c in cells.items()])
        .filter(F.col("_on_spine") == 1)
        .drop("_on_spine")
    )


def _event_keys(events: DataFrame, name: str, day: str, order: list[Column]) -> DataFrame:
    keyed = events.withColumns({"_name": S.normalise_name(name), "_quarter": S.quarter_start(day)})
    return dedup_keep_last(keyed, ["_name", "_quarter"], order)


def event_join(panel: DataFrame, events: DataFrame, name: str, day: str, order: list[Column], panel_name: str = "bank_name") -> DataFrame:
    """Mark panel rows named in an event list of the same quarter with ``failed`` = 1.0.

    Names match without regard to case and white space.
    """
    marks = _event_keys(events, name, day, order).select("_name", F.col("_quarter").alias("date"), F.lit(1.0).alias("failed"))
    return panel.withColumn("_name", S.normalise_name(panel_name)).join(marks, ["_name", "date"], "left").drop("_name")


def unmatched_events(panel: DataFrame, events: DataFrame, name: str, day: str, order: list[Column], panel_name: str = "bank_name") -> DataFrame:
    """Events whose name occurs nowhere in the panel."""
    known = panel.select(S.normalise_name(panel_name).alias("_name")).distinct()
    return _event_keys(events, name, day, order).join(known, "_name", "left_anti").drop("_name", "_quarter")


def horizontal_concat(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Outer alignment on the keys; columns the left side already has are taken from it."""
    extra = [c for c in right.columns if c in keys or c not in left.columns]
    return left.join(right.select(*extra), keys, "full")


def keep_entities(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return df.join(ids.select(id_col), id_col, "left_semi")


def keep_keys(df: DataFrame, keys: DataFrame, on: Iterable[str] = ("id", "date")) -> DataFrame:
    on = list(on)
    return df.join(keys.select(*on), on, "left_semi")


def metric_lookup(runs: DataFrame, metrics: DataFrame, metric: str = "r2", keys: Sequence[str] = ("target", "horizon", "model")) -> DataFrame:
    """Annotate rows of a run table with one metric of the same run."""
    return runs.join(metrics.select(*keys, metric), list(keys), "left")
