"""Queries on aggregates, profiles and data-quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators import aggregates as A
from ledgerline.operators import clean, metrics, sample
from ledgerline.operators.joins import event_join, macro_panel_join
from ledgerline.operators.windows import panel_changes
from ledgerline.plans.panel import ratio_suite, stage_stats
from ledgerline.queries import fixtures as fx
from ledgerline.queries.registry import query

TOTALS = [
    "total_assets", "total_loans_and_leases", "total_deposits", "total_equity", "interest_income", "interest_expense", "net_income",
    "non_interest_expense", "non_interest_income", "allowance_for_loan_and_lease_losses", "allowance_for_credit_losses", "net_charge_offs",
]


@query(
    "system_totals", "date:d " + " ".join(f"{c}:4" for c in TOTALS), "panel",
    "SELECT date, " + ", ".join(f"coalesce(sum({c}), 0) AS {c}" for c in TOTALS) + " FROM panel GROUP BY date",
)
def system_totals(spark, sf):
    return A.system_totals(fx.panel(spark, sf), TOTALS)


_BANDS = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def _quantiles(column: str, names: str = "{q}") -> str:
    return ", ".join(f"quantile_cont({column}, {p}) AS {names.format(q=q)}" for q, p in _BANDS.items())


@query(
    "date_profile", "date:d mean:6 q25:6 median:6 q75:6", "panel",
    f"SELECT date, avg(r) AS mean, {_quantiles('r')} FROM (SELECT date, total_equity / total_assets AS r FROM panel) GROUP BY date",
)
def date_profile(spark, sf):
    return A.date_profile(fx.panel(spark, sf).select("date", S.ratio("total_equity", "total_assets").alias("r")), "r")


@query("macro_date_mean", "date:d gdp:4 cpi:4", "panel", "macro", "SELECT date, avg(gdp) AS gdp, avg(cpi) AS cpi FROM panel JOIN macro USING (date) GROUP BY date")
def macro_date_mean(spark, sf):
    joined = macro_panel_join(fx.panel(spark, sf), fx.macro_levels(spark, sf))
    return A.date_mean(joined, ["gdp", "cpi"])


@query(
    "quantile_band", "date:d " + " ".join(f"{c}_{q}:6" for c in ("label", "prediction") for q in _BANDS), "panel", "predictions",
    f"""SELECT date, {_quantiles('label', 'label_{q}')}, {_quantiles('prediction', 'prediction_{q}')}
        FROM predictions WHERE model = 'last' GROUP BY date""",
)
def quantile_band(spark, sf):
    return A.quantile_bands(fx.predictions(spark, sf).filter("model = 'last'"), ["label", "prediction"])


DESCRIBED = ["deposit_ratio", "loan_to_asset_ratio", "log_total_assets", "roa", "total_assets_qoq", "net_charge_offs_to_loans_and_leases"]


@query(
    "describe_by_variable", "variable display count:i mean:6 std:6 min:6 q25:6 median:6 q75:6 max:6", "panel", "macro",
    "j AS (SELECT * FROM panel WHERE date IN (SELECT date FROM macro))",
    f"""SELECT variable, CASE variable WHEN 'deposit_ratio' THEN 'Deposit Ratio' WHEN 'loan_to_asset_ratio' THEN 'Loan-to-Asset Ratio'
         WHEN 'log_total_assets' THEN 'Log(Total Assets)' WHEN 'roa' THEN 'Return on Assets (ROA)'
         WHEN 'net_charge_offs_to_loans_and_leases' THEN 'Net Charge-Offs / Loans' ELSE variable END AS display,
         count(*) AS count, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max, {_quantiles('v')} FROM (
         SELECT 'deposit_ratio' AS variable, total_deposits / total_assets AS v FROM j UNION ALL
         SELECT 'loan_to_asset_ratio', total_loans_and_leases / total_assets FROM j UNION ALL SELECT 'log_total_assets', ln(total_assets) FROM j UNION ALL
         SELECT 'roa', net_income / total_assets FROM j UNION ALL
         SELECT 'total_assets_qoq', total_assets / lag(total_assets) OVER (PARTITION BY id ORDER BY date) - 1 FROM j UNION ALL
         SELECT 'net_charge_offs_to_loans_and_leases', net_charge_offs / total_loans_and_leases FROM j) WHERE v IS NOT NULL GROUP BY variable""",
)
def describe_by_variable(spark, sf):
    joined = macro_panel_join(fx.panel(spark, sf), fx.macro_levels(spark, sf))
    featured = panel_changes(ratio_suite(joined, DESCRIBED), ["total_assets"])
    return A.describe_by_variable(featured, DESCRIBED).withColumn("display", S.display_name("variable"))


CORRELATED = ["deposit_ratio", "roa", "npl_ratio", "equity_to_asset_ratio", "rwa_ratio"]
_CORR = {"deposit_ratio": "total_deposits / total_assets", "roa": "net_income / total_assets", "npl_ratio": "npl / total_loans_and_leases",
         "equity_to_asset_ratio": "total_equity / total_assets", "rwa_ratio": "total_rwa / total_assets"}


@query(
    "corr_matrix", "var_a var_b r:6", "panel",
    "r AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _CORR.items()) + " FROM panel)",
    " UNION ALL ".join(
        f"SELECT '{a}' AS var_a, '{b}' AS var_b, " + ("1.0" if a == b else f"corr({a}, {b})") + " AS r FROM r" for a in CORRELATED for b in CORRELATED
    ).replace("1.0 AS r FROM r", "max(1.0) AS r FROM r"),
)
def corr_matrix(spark, sf):
    return A.correlation_table(ratio_suite(fx.panel(spark, sf), CORRELATED), CORRELATED)


@query("distinct_entities", "n_id:i n_date:i", "thin", "SELECT count(DISTINCT id) AS n_id, count(DISTINCT date) AS n_date FROM thin")
def distinct_entities(spark, sf):
    return A.distinct_counts(fx.thin(spark, sf), "id", "date")


@query(
    "obs_per_entity", "id date:d total_assets:4", "thin",
    "SELECT * FROM thin WHERE id IN (SELECT id FROM thin GROUP BY id HAVING count(total_assets) >= 8)",
)
def obs_per_entity(spark, sf):
    return sample.min_observations(fx.thin(spark, sf), "total_assets", 8)


@query("avg_dates_per_entity", "avg_dates_per_entity:6", "thin", "SELECT avg(n) AS avg_dates_per_entity FROM (SELECT count(DISTINCT date) AS n FROM thin GROUP BY id)")
def avg_dates_per_entity(spark, sf):
    return A.average_dates_per_entity(fx.thin(spark, sf))


@query(
    "entity_threshold_min", "id date:d total_assets:4", "thin",
    "SELECT * FROM thin WHERE id IN (SELECT id FROM thin GROUP BY id HAVING min(total_assets) >= 50000)",
)
def entity_threshold_min(spark, sf):
    return sample.min_ratio(fx.thin(spark, sf), "total_assets", 50000.0)


@query(
    "entity_threshold_mean", "id date:d total_assets:4", "thin",
    "SELECT * FROM thin WHERE id IN (SELECT id FROM thin GROUP BY id HAVING avg(total_assets) >= 300000)",
)
def entity_threshold_mean(spark, sf):
    return sample.min_mean_size(fx.thin(spark, sf), "total_assets", 300000.0)


@query(
    "global_moments", "total_assets_mean:4 total_assets_std:4 npl_mean:4 npl_std:4", "panel",
    "SELECT avg(total_assets) AS total_assets_mean, stddev_samp(total_assets) AS total_assets_std, avg(npl) AS npl_mean, stddev_samp(npl) AS npl_std FROM panel",
)
def global_moments(spark, sf):
    return A.global_moments(fx.panel(spark, sf), ["total_assets", "npl"])


@query(
    "global_quantile", "variable lo:4 hi:4",
    """SELECT 'l_extendedprice' AS variable, quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem UNION ALL
       SELECT 'l_quantity', quantile_cont(l_quantity, 0.01), quantile_cont(l_quantity, 0.99) FROM lineitem""",
)
def global_quantile(spark, sf):
    return A.global_quantiles(fx.table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"], {"lo": 0.01, "hi": 0.99})


@query(
    "multi_event_entities", "id events:0", "thin", "events",
    """SELECT id, sum(1.0) AS events FROM named JOIN event_keys ON k = regexp_replace(lower(bank_name), '\\s+', '', 'g') AND q = date GROUP BY id HAVING count(*) > 1""",
)
def multi_event_entities(spark, sf):
    joined = event_join(fx.named_thin(spark, sf), fx.event_list(spark, sf), "name", "day", [F.col("day"), F.col("name")])
    return A.multi_event_entities(joined)


_GRID = """dates AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM thin), (SELECT max(date) FROM thin), INTERVAL 3 MONTH)) AS DATE) AS date),
grid AS (SELECT i.id, g.date, t.total_assets FROM (SELECT DISTINCT id FROM thin) i CROSS JOIN dates g LEFT JOIN thin t ON t.id = i.id AND t.date = g.date)"""


@query(
    "all_notnull_entities", "entities:i complete:i incomplete:i complete_pct:4 missing_cells:i", "thin", _GRID,
    """SELECT count(*) AS entities, count(CASE WHEN full_ THEN 1 END) AS complete, count(CASE WHEN NOT full_ THEN 1 END) AS incomplete,
       count(CASE WHEN full_ THEN 1 END) * 100.0 / count(*) AS complete_pct, sum(missing) AS missing_cells
       FROM (SELECT id, bool_and(total_assets IS NOT NULL) AS full_, count(*) - count(total_assets) AS missing FROM grid GROUP BY id)""",
)
def all_notnull_entities(spark, sf):
    return A.complete_entities(fx.thin(spark, sf), "total_assets")


@query("nulls_by_date", "date:d missing:i", "thin", _GRID, "SELECT date, count(*) - count(total_assets) AS missing FROM grid GROUP BY date")
def nulls_by_date(spark, sf):
    return A.observations_per_date(fx.thin(spark, sf), "total_assets")


@query(
    "missingness_report", "entities:i complete:i missing_cells:i removed_entities:i", "thin", _GRID,
    """SELECT count(*) AS entities, count(CASE WHEN missing = 0 THEN 1 END) AS complete, sum(missing) AS missing_cells, count(CASE WHEN known < 8 THEN 1 END) AS removed_entities
       FROM (SELECT id, count(*) - count(total_assets) AS missing, count(total_assets) AS known FROM grid GROUP BY id)""",
)
def missingness_report(spark, sf):
    return A.missingness_report(fx.thin(spark, sf), "total_assets", 8)


@query(
    "histogram", "bin:i bin_start:2 n:i", "panel",
    """SELECT bin, (SELECT min(total_assets) FROM panel WHERE year(date) = 1998) + bin * (SELECT (max(total_assets) - min(total_assets)) / 50 FROM panel WHERE year(date) = 1998) AS bin_start, count(*) AS n
       FROM (SELECT least(49, CAST(floor((total_assets - lo) / (hi - lo) * 50) AS INT)) AS bin FROM panel, (SELECT min(total_assets) AS lo, max(total_assets) AS hi FROM panel WHERE year(date) = 1998)
       WHERE year(date) = 1998) GROUP BY bin""",
)
def histogram(spark, sf):
    return A.histogram(clean.one_year(fx.panel(spark, sf), 1998), "total_assets", 50)


@query(
    "stage_stats", "stage rows:i entities:i min_date:d max_date:d", "thin",
    """SELECT 'initial' AS stage, count(*) AS rows, count(DISTINCT id) AS entities, min(date) AS min_date, max(date) AS max_date FROM thin UNION ALL
       SELECT 'known', count(*), count(DISTINCT id), min(date), max(date) FROM thin WHERE total_assets IS NOT NULL UNION ALL
       SELECT 'min_observations', count(*), count(DISTINCT id), min(date), max(date) FROM thin WHERE total_assets IS NOT NULL
       AND id IN (SELECT id FROM thin GROUP BY id HAVING count(total_assets) >= 8)""",
)
def stage_stats_query(spark, sf):
    first = fx.thin(spark, sf)
    known = first.filter("total_assets is not null")
    return stage_stats({"initial": first, "known": known, "min_observations": sample.min_observations(known, "total_assets", 8)})


_SPLIT_SQL = ", ".join(
    f"count(DISTINCT CASE WHEN split = '{s}' THEN id END) AS {s}_entities, count(DISTINCT CASE WHEN split = '{s}' THEN date END) AS {s}_dates, "
    f"count(CASE WHEN split = '{s}' THEN 1 END) AS {s}_rows" for s in ("train", "test")
)


@query(
    "split_characteristics", "target horizon:i model train_entities:i train_dates:i train_rows:i test_entities:i test_dates:i test_rows:i total_entities:i",
    "panel", "predictions", f"SELECT target, horizon, model, {_SPLIT_SQL}, count(DISTINCT id) AS total_entities FROM predictions GROUP BY 1, 2, 3",
)
def split_characteristics(spark, sf):
    return metrics.split_characteristics(fx.predictions(spark, sf))


@query(
    "run_coverage", "target horizon:i model split missing:i entities:i first_date:d last_date:d avg_dates_per_entity:6", "panel", "predictions",
    """SELECT target, horizon, model, split, sum(CASE WHEN label IS NULL THEN 1 ELSE 0 END) AS missing, count(DISTINCT id) AS entities, min(date) AS first_date,
       max(date) AS last_date, count(DISTINCT (id, date)) * 1.0 / count(DISTINCT id) AS avg_dates_per_entity FROM predictions GROUP BY 1, 2, 3, 4""",
)
def run_coverage(spark, sf):
    return metrics.run_coverage(fx.predictions(spark, sf))
