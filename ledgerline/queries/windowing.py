"""Queries on order-dependent operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators import design, windows
from ledgerline.queries import fixtures as fx
from ledgerline.queries.registry import query
from ledgerline.sources import series

W = "(PARTITION BY id ORDER BY date)"


@query(
    "series_diff", "series date:d diff:4", "macro", "macro_long",
    "SELECT series, date, value - lag(value) OVER (PARTITION BY series ORDER BY date) AS diff FROM macro_long",
)
def series_diff(spark, sf):
    return windows.diff(fx.macro_long(spark, sf), ["value"], "series").withColumnRenamed("value_diff", "diff")


_FF = "last_value({c} IGNORE NULLS) OVER (PARTITION BY {k} ORDER BY date ROWS UNBOUNDED PRECEDING)"


@query(
    "series_pct_change", "series date:d qoq:6 yoy:6", "macro", "macro_long",
    f"""SELECT series, date, f / nullif(lag(f, 1) OVER w, 0) - 1 AS qoq, f / nullif(lag(f, 4) OVER w, 0) - 1 AS yoy
        FROM (SELECT *, {_FF.format(c='value', k='series')} AS f FROM macro_long) WINDOW w AS (PARTITION BY series ORDER BY date)""",
)
def series_pct_change(spark, sf):
    return series.long_changes(fx.macro_long(spark, sf))


_MACRO_SPEC = "date:d tbill_3m:6 gdp_qoq:6 gdp_yoy:6 cons_sentiment:6 cons_sentiment_qoq:6 vix_qoq:6 tbill_10y_diff:6 household_delinq_diff:6 corp_bond_spread_diff:6 spread_10y_3m:6 spread_10y_1y_diff:6"


@query(
    "macro_transforms", _MACRO_SPEC, "macro",
    f"""SELECT date, tbill_3m / 100 AS tbill_3m, gdp / lag(gdp) OVER w - 1 AS gdp_qoq, gdp / lag(gdp, 4) OVER w - 1 AS gdp_yoy,
        cons_sentiment / 100 AS cons_sentiment, cs / lag(cs) OVER w - 1 AS cons_sentiment_qoq, vx / lag(vx) OVER w - 1 AS vix_qoq,
        (tbill_10y - lag(tbill_10y) OVER w) / 100 AS tbill_10y_diff, (household_delinq - lag(household_delinq) OVER w) / 100 AS household_delinq_diff,
        (corp_bond_spread - lag(corp_bond_spread) OVER w) / 100 AS corp_bond_spread_diff, (tbill_10y - tbill_3m) / 100 AS spread_10y_3m,
        (tbill_10y - tbill_1y - lag(tbill_10y - tbill_1y) OVER w) / 100 AS spread_10y_1y_diff
        FROM (SELECT *, last_value(cons_sentiment IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS cs,
              last_value(vix IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS vx FROM macro) WINDOW w AS (ORDER BY date)""",
)
def macro_transforms(spark, sf):
    return series.macro_table(fx.macro_long(spark, sf))


@query(
    "industry_transforms", "date:d income_to_assets:6 total_assets_qoq:6 income_diff:4", "panel",
    """SELECT date, income / total_assets AS income_to_assets, total_assets / lag(total_assets) OVER w - 1 AS total_assets_qoq, income - lag(income) OVER w AS income_diff
       FROM (SELECT date, sum(total_assets) AS total_assets, sum(net_income) AS income FROM panel GROUP BY date) WINDOW w AS (ORDER BY date)""",
)
def industry_transforms(spark, sf):
    sums = fx.panel(spark, sf).groupBy("date").agg(F.sum("total_assets").alias("total_assets"), F.sum("net_income").alias("income"))
    long = sums.unpivot("date", ["total_assets", "income"], "series", "value")
    return series.industry_table(long, "total_assets", ["total_assets", "income"], ["income"], ["total_assets"], ["income"])


@query(
    "panel_diff", "id date:d total_assets_diff:4 npl_diff:4", "panel",
    f"SELECT id, date, total_assets - lag(total_assets) OVER {W} AS total_assets_diff, npl - lag(npl) OVER {W} AS npl_diff FROM panel",
)
def panel_diff(spark, sf):
    return windows.diff(fx.panel(spark, sf), ["total_assets", "npl"], "id")


@query(
    "panel_pct_change", "id date:d total_assets_qoq:6", "thin",
    f"SELECT id, date, f / nullif(lag(f) OVER {W}, 0) - 1 AS total_assets_qoq FROM (SELECT *, {_FF.format(c='total_assets', k='id')} AS f FROM thin)",
)
def panel_pct_change(spark, sf):
    return windows.panel_changes(fx.thin(spark, sf), ["total_assets"])


_YTD = """ytd AS (SELECT id, date, CASE WHEN orders = 2 THEN NULL ELSE round(sum(orders * 10) OVER (PARTITION BY id, year(date) ORDER BY date ROWS UNBOUNDED PRECEDING), 4) END AS flow FROM thin)"""


@query(
    "ytd_to_quarterly", "id date:d flow:4", "thin", _YTD,
    "SELECT id, date, coalesce(flow - lag(flow) OVER (PARTITION BY id, year(date) ORDER BY date), flow) AS flow FROM ytd",
)
def ytd_to_quarterly(spark, sf):
    w = Window.partitionBy("id", F.year("date")).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    running = F.round(F.sum(F.col("orders") * 10).over(w), 4)
    ytd = fx.thin(spark, sf).select("id", "date", F.when(F.col("orders") != 2, running).alias("flow"))
    return windows.ytd_to_quarterly(ytd, ["flow"])


_GAPS = """grid AS (SELECT i.id, g.date, t.total_assets, t.orders FROM (SELECT DISTINCT id FROM thin) i
  CROSS JOIN (SELECT CAST(unnest(generate_series((SELECT min(date) FROM thin), (SELECT max(date) FROM thin), INTERVAL 3 MONTH)) AS DATE) AS date) g
  LEFT JOIN thin t ON t.id = i.id AND t.date = g.date),
filled AS (SELECT id, date, orders, coalesce(total_assets, CASE WHEN n IS NOT NULL THEN p END) AS total_assets, total_assets IS NULL AS gap
  FROM (SELECT *, lag(total_assets) OVER w AS p, lead(total_assets) OVER w AS n FROM grid WINDOW w AS (PARTITION BY id ORDER BY date)))"""


@query(
    "gap_fill_single", "id date:d total_assets:4 orders:0 filled:i", "thin", _GAPS,
    "SELECT *, CAST(gap AS INT) AS filled FROM filled WHERE total_assets IS NOT NULL",
)
def gap_fill_single(spark, sf):
    return windows.gap_fill_single(fx.thin(spark, sf), "total_assets").withColumn("filled", F.col("gap_filled").cast("int"))


@query(
    "group_size_by_date", "date:d count_filled:i", "thin", _GAPS,
    "SELECT date, count(*) AS count_filled FROM filled WHERE gap AND total_assets IS NOT NULL GROUP BY date",
)
def group_size_by_date(spark, sf):
    return windows.fill_summary(windows.gap_fill_single(fx.thin(spark, sf), "total_assets"))


@query(
    "ar_lags", "id date:d net_income_ar_lag_1:4 net_income_ar_lag_2:4 net_income_ar_lag_3:4", "panel",
    "SELECT id, date, " + ", ".join(f"lag(net_income, {k}) OVER {W} AS net_income_ar_lag_{k}" for k in (1, 2, 3)) + " FROM panel",
)
def ar_lags(spark, sf):
    return windows.ar_lags(fx.panel(spark, sf), "net_income", 3)[0]


@query(
    "feature_lags", "id date:d split npl_lag_1:4 npl_lag_2:4 total_assets_lag_1:4 total_assets_lag_2:4", "panel",
    # As defined: train lags see train rows only, test lags see both.
    """SELECT id, date, 'train' AS split, lag(npl, 1) OVER w AS npl_lag_1, lag(npl, 2) OVER w AS npl_lag_2, lag(total_assets, 1) OVER w AS total_assets_lag_1,
         lag(total_assets, 2) OVER w AS total_assets_lag_2 FROM panel WHERE date <= DATE '1999-10-01' WINDOW w AS (PARTITION BY id ORDER BY date)
       UNION ALL SELECT * FROM (SELECT id, date, 'test', lag(npl, 1) OVER w, lag(npl, 2) OVER w, lag(total_assets, 1) OVER w,
         lag(total_assets, 2) OVER w FROM panel WINDOW w AS (PARTITION BY id ORDER BY date)) WHERE date > DATE '1999-10-01'""",
)
def feature_lags(spark, sf):
    rows = design.split_by_date(fx.panel(spark, sf), "1999-10-01")
    return windows.feature_lags(rows, ["npl", "total_assets"], 2)[0]


@query(
    "lead_target", "id date:d split label:4", "panel",
    """SELECT id, date, split, lead(net_income, 2) OVER (PARTITION BY split, id ORDER BY date) AS label
       FROM (SELECT *, CASE WHEN date <= DATE '1999-10-01' THEN 'train' ELSE 'test' END AS split FROM panel)""",
)
def lead_target(spark, sf):
    return windows.lead_target(design.split_by_date(fx.panel(spark, sf), "1999-10-01"), "net_income", 2)


@query(
    "abs_change_filter", "id date:d r:6", "panel",
    f"""SELECT id, date, r FROM (SELECT *, coalesce(abs(r - lag(r) OVER {W}), 0) AS step FROM
        (SELECT id, date, total_deposits / total_assets AS r FROM panel)) WHERE step <= 0.05""",
)
def abs_change_filter(spark, sf):
    rows = fx.panel(spark, sf).select("id", "date", S.ratio("total_deposits", "total_assets").alias("r"))
    return windows.abs_change_filter(rows, "r", 0.05)


_FLAGS = f"""steps AS (SELECT *, x - lag(x) OVER {W} AS step FROM (SELECT id, date, ln(total_assets) AS x FROM panel)),
flags AS (SELECT id, date, x, lag(x) OVER {W} AS px, coalesce(abs(step) > 1.5 * (SELECT stddev_samp(step) FROM steps), FALSE) AS hit FROM steps)"""


@query("break_flag", "id date:d x:6 hit:i", "panel", _FLAGS, "SELECT id, date, x, CAST(hit AS INT) AS hit FROM flags")
def break_flag(spark, sf):
    rows = fx.panel(spark, sf).select("id", "date", S.log_floor("total_assets").alias("x"))
    return windows.break_flags(rows, "x", 1.5, "hit")


@query(
    "break_back_adjust", "id date:d x:6", "panel", _FLAGS,
    """SELECT id, date, x * coalesce(product(f) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1) AS x
       FROM (SELECT *, CASE WHEN hit AND px <> 0 THEN x / px END AS f FROM flags)""",
)
def break_back_adjust(spark, sf):
    rows = fx.panel(spark, sf).select("id", "date", S.log_floor("total_assets").alias("x"))
    return windows.back_adjust(windows.break_flags(rows, "x", 1.5), "x")


@query(
    "resample_first", "date:d sp500:4", "daily",
    """SELECT g.q + INTERVAL 3 MONTH AS date, f.v AS sp500 FROM
       (SELECT CAST(unnest(generate_series((SELECT date_trunc('quarter', min(day)) FROM daily), (SELECT max(day) FROM daily), INTERVAL 3 MONTH)) AS DATE) AS q) g
       LEFT JOIN (SELECT date_trunc('quarter', day) AS q, arg_min(close, day) AS v FROM daily GROUP BY 1) f ON f.q = g.q""",
)
def resample_first(spark, sf):
    return windows.resample_first(fx.daily_index(spark, sf), "close", name="sp500")


@query(
    "resample_mean", "series date:d value:4",
    "SELECT o_orderpriority AS series, date_trunc('quarter', o_orderdate) AS date, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2",
)
def resample_mean(spark, sf):
    return windows.resample_mean(fx.table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "o_orderdate")
