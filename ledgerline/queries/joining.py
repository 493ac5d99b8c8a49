"""Queries on joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import joins, metrics, windows
from ledgerline.plans.panel import merge_tables
from ledgerline.queries import fixtures as fx
from ledgerline.queries.registry import query
from ledgerline.sources.series import MACRO_SERIES, index_table


@query(
    "macro_panel_join", "id date:d total_assets:4 gdp:4 vix:4 sp500:4", "panel", "macro", "daily", "index_q",
    "SELECT id, date, total_assets, gdp, vix, sp500 FROM panel JOIN macro USING (date) LEFT JOIN index_q USING (date)",
)
def macro_panel_join(spark, sf):
    index = index_table(fx.daily_index(spark, sf), "close").select("date", "sp500")
    return merge_tables(fx.panel(spark, sf), fx.macro_levels(spark, sf), index)


@query(
    "series_left_chain", "date:d " + " ".join(f"{n}:4" for n in MACRO_SERIES), "macro", "macro_long",
    "SELECT date, " + ", ".join(f"max(CASE WHEN series = '{n}' THEN value END) AS {n}" for n in MACRO_SERIES)
    + " FROM macro_long GROUP BY date HAVING count(CASE WHEN series = 'gdp' THEN 1 END) > 0",
)
def series_left_chain(spark, sf):
    return joins.series_wide(fx.macro_long(spark, sf), "gdp", MACRO_SERIES)



@query(
    "fuzzy_name_event_join", "id date:d bank_name failed:0", "thin", "events",
    """SELECT id, date, bank_name, CASE WHEN k IS NOT NULL THEN 1.0 END AS failed FROM named
       LEFT JOIN event_keys ON k = regexp_replace(lower(bank_name), '\\s+', '', 'g') AND q = date""",
)
def fuzzy_name_event_join(spark, sf):
    return joins.event_join(fx.named_thin(spark, sf), fx.event_list(spark, sf), "name", "day", [F.col("day"), F.col("name")])


@query(
    "unmatched_anti_join", "name day:d", "thin", "events",
    """SELECT name, max(day) AS day FROM events_ WHERE regexp_replace(lower(name), '\\s+', '', 'g') NOT IN
       (SELECT regexp_replace(lower(bank_name), '\\s+', '', 'g') FROM named) GROUP BY name, date_trunc('quarter', day)""",
)
def unmatched_anti_join(spark, sf):
    return joins.unmatched_events(fx.named_thin(spark, sf), fx.event_list(spark, sf), "name", "day", [F.col("day"), F.col("name")])


@query(
    "horizontal_concat", "id date:d total_assets:4 total_deposits:4 npl:4", "panel",
    """SELECT id, date, a.total_assets, b.total_deposits, b.npl FROM (SELECT * FROM panel WHERE month(date) <> 1) a
       FULL JOIN (SELECT * FROM panel WHERE month(date) <> 7) b USING (id, date)""",
)
def horizontal_concat(spark, sf):
    base = fx.panel(spark, sf)
    left = base.filter(F.month("date") != 1).select("id", "date", "total_assets")
    right = base.filter(F.month("date") != 7).select("id", "date", "total_assets", "total_deposits", "npl")
    return joins.horizontal_concat(left, right, ["id", "date"])


@query(
    "entity_semi_join", "id date:d orders:i", "thin",
    "SELECT * FROM thin WHERE id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'HOUSEHOLD')",
)
def entity_semi_join(spark, sf):
    ids = fx.table(spark, sf, "customer").filter("c_mktsegment = 'HOUSEHOLD'").select(F.col("c_custkey").cast("string").alias("id"))
    return joins.keep_entities(fx.thin(spark, sf), ids)


@query(
    "panel_spine", "id date:d total_assets:4", "thin",
    """SELECT i.id, g.date, t.total_assets FROM (SELECT DISTINCT id FROM thin) i
       CROSS JOIN (SELECT CAST(unnest(generate_series((SELECT min(date) FROM thin), (SELECT max(date) FROM thin), INTERVAL 3 MONTH)) AS DATE) AS date) g
       LEFT JOIN thin t ON t.id = i.id AND t.date = g.date""",
)
def panel_spine(spark, sf):
    return windows.panel_spine(fx.thin(spark, sf))


_R2 = "1 - avg((label - prediction) * (label - prediction)) / var_pop(label)"


@query(
    "metric_lookup", "target horizon:i model entities:i r2:6", "panel", "predictions",
    f"SELECT target, horizon, model, count(DISTINCT id) AS entities, {_R2} AS r2 FROM predictions GROUP BY 1, 2, 3",
)
def metric_lookup(spark, sf):
    rows = fx.predictions(spark, sf)
    runs = rows.groupBy("target", "horizon", "model").agg(F.count_distinct("id").alias("entities"))
    return joins.metric_lookup(runs, metrics.regression_metrics(rows, metrics.RUN_KEYS))


@query(
    "key_membership_split", "id date:d total_assets:4", "panel", "predictions",
    "SELECT id, date, total_assets FROM panel WHERE (id, date) IN (SELECT id, date FROM predictions WHERE split = 'test')",
)
def key_membership_split(spark, sf):
    return joins.keep_keys(fx.panel(spark, sf), fx.predictions(spark, sf).filter("split = 'test'"))
