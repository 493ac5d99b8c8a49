"""Queries on projections, filters, cleaning and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators import clean
from ledgerline.operators.design import entity_effect
from ledgerline.operators.design import quarter_effect as quarter_name
from ledgerline.plans import panel as plans
from ledgerline.queries import fixtures as fx
from ledgerline.queries.registry import query


@query("column_name_clean", "k:i name", "SELECT c_custkey AS k, c_name AS name FROM customer")
def column_name_clean(spark, sf):
    odd = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias(' "k" '), F.col("c_name").alias('"name"'))
    return clean.clean_column_names(odd)


def _raw_keys(spark, sf):
    k = F.col("c_custkey")
    key = F.when(k % 7 == 0, F.lit("   ")).when(k % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("  "), k.cast("string"), F.lit(" ")))
    return fx.table(spark, sf, "customer").select(key.alias("id"), F.col("c_acctbal").alias("v"))


@query("key_standardise", "id v:2", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_acctbal AS v FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0")
def key_standardise(spark, sf):
    return clean.standardise_key(_raw_keys(spark, sf), "id")


_NULLABLE = ["allowance_for_loan_and_lease_losses", "allowance_for_credit_losses", "provisions_for_credit_losses"]
_NULLABLE_SPEC = "id date:d " + " ".join(f"{c}:4" for c in _NULLABLE)
_ALL_NULL = " AND ".join(f"{c} IS NULL" for c in _NULLABLE)


@query("drop_all_null_rows", _NULLABLE_SPEC, "panel", f"SELECT * FROM panel WHERE NOT ({_ALL_NULL})")
def drop_all_null_rows(spark, sf):
    return clean.drop_all_null_rows(fx.panel(spark, sf).select("id", "date", *_NULLABLE), ["id", "date"])


@query("drop_any_null_rows", _NULLABLE_SPEC, "panel", "SELECT * FROM panel WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _NULLABLE))
def drop_any_null_rows(spark, sf):
    return clean.drop_any_null_rows(fx.panel(spark, sf).select("id", "date", *_NULLABLE), _NULLABLE)


_ITEM = "l_orderkey:i l_linenumber:i l_partkey:i l_suppkey:i l_quantity:2 l_extendedprice:2"
_ITEM_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


def _dedup_sql(direction: str) -> str:
    order = ", ".join(f"{c} {direction}" for c in _ITEM_ORDER)
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {order}) AS rn FROM lineitem) WHERE rn = 1"


@query("dedup_keep_first", _ITEM, _dedup_sql("ASC"))
def dedup_keep_first(spark, sf):
    return clean.dedup_keep_first(fx.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col(c) for c in _ITEM_ORDER])


@query("dedup_keep_last", _ITEM, _dedup_sql("DESC"))
def dedup_keep_last(spark, sf):
    return clean.dedup_keep_last(fx.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col(c) for c in _ITEM_ORDER])


@query("null_key_filter", "id v:2", """SELECT CASE WHEN c_custkey % 7 = 0 THEN '   ' ELSE '  ' || c_custkey || ' ' END AS id, c_acctbal AS v
       FROM customer WHERE c_custkey % 11 <> 0 OR c_custkey % 7 = 0""")
def null_key_filter(spark, sf):
    return clean.non_null_keys(_raw_keys(spark, sf), "id")


def _mixed_ids(spark, sf):
    k = F.col("c_custkey")
    return fx.table(spark, sf, "customer").select(F.when(k % 6 == 0, F.concat(k, F.lit("A"))).otherwise(k.cast("string")).alias("id"))


@query("numeric_id_filter", "id", "SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 6 <> 0")
def numeric_id_filter(spark, sf):
    return clean.numeric_ids(_mixed_ids(spark, sf))


@query("non_numeric_id_report", "id", "SELECT c_custkey || 'A' AS id FROM customer WHERE c_custkey % 6 = 0")
def non_numeric_id_report(spark, sf):
    return clean.non_numeric_ids(_mixed_ids(spark, sf))


@query(
    "coerce_numeric", "rows:i known:i total:2",
    """SELECT count(*) AS rows, count(v) AS known, sum(v) AS total FROM (SELECT CASE WHEN l_linenumber = 1 OR l_linenumber = 3 THEN NULL
       WHEN l_linenumber = 2 THEN -l_extendedprice ELSE l_extendedprice END AS v FROM lineitem)""",
)
def coerce_numeric(spark, sf):
    n, price = F.col("l_linenumber"), F.col("l_extendedprice").cast("string")
    text = F.when(n == 1, F.concat(price, F.lit(" USD"))).when(n == 3, F.lit("n/a")).when(n == 2, F.concat(F.lit(" -"), price)).otherwise(price)
    typed = clean.coerce_types(fx.table(spark, sf, "lineitem").select(text.alias("v")), [], [])
    return typed.agg(F.count("*").alias("rows"), F.count("v").alias("known"), F.sum("v").alias("total"))


@query(
    "coerce_date", "day:d rows:i",
    "SELECT CASE WHEN l_linenumber > 1 THEN CAST(l_shipdate AS DATE) END AS day, count(*) AS rows FROM lineitem GROUP BY 1",
)
def coerce_date(spark, sf):
    text = F.date_format("l_shipdate", "yyyyMMdd")
    broken = F.when(F.col("l_linenumber") == 1, F.concat(F.substring(text, 1, 4), F.lit("1340"))).otherwise(text)
    typed = clean.coerce_types(fx.table(spark, sf, "lineitem").select(broken.alias("day")), [], ["day"])
    return typed.groupBy("day").agg(F.count("*").alias("rows"))


@query("quarter_start", "quarter:d rows:i", "SELECT date_trunc('quarter', l_shipdate) AS quarter, count(*) AS rows FROM lineitem GROUP BY 1")
def quarter_start(spark, sf):
    return fx.table(spark, sf, "lineitem").groupBy(S.quarter_start("l_shipdate").alias("quarter")).agg(F.count("*").alias("rows"))


def _coded(spark, sf):
    return fx.panel(spark, sf).select(
        F.col("id").alias("IDRSSD"), F.col("date").alias("RCON9999"), F.col("dom_assets").alias("RCON2170"),
        F.col("con_assets").alias("RCFD2170"), F.col("npl").alias("RCFDA570"), F.col("interest_income").alias("RIAD4107"),
        F.col("net_income").alias("RIAD4340"),
    )


@query(
    "coalesce_dual_code", "IDRSSD RCON9999:d RCON2170:4 RCFDA570:4 RIAD4107:4 RIAD4340:4", "panel",
    """SELECT id AS "IDRSSD", date AS "RCON9999", coalesce(dom_assets, con_assets) AS "RCON2170", npl AS "RCFDA570", interest_income AS "RIAD4107", net_income AS "RIAD4340" FROM panel""",
)
def coalesce_dual_code(spark, sf):
    return clean.coalesce_dual_codes(_coded(spark, sf))


@query(
    "rename_by_dictionary", "id date:d total_assets:4 all_other_loans_3m_less:4 interest_income:4 net_income:4", "panel",
    "SELECT id, date, coalesce(dom_assets, con_assets) AS total_assets, npl AS all_other_loans_3m_less, interest_income, net_income FROM panel",
)
def rename_by_dictionary(spark, sf):
    return clean.rename_codes(clean.coalesce_dual_codes(_coded(spark, sf)))


@query(
    "prefix_column_select", "IDRSSD RIAD4107:4 RIAD4340:4", "panel",
    """SELECT id AS "IDRSSD", interest_income AS "RIAD4107", net_income AS "RIAD4340" FROM panel""",
)
def prefix_column_select(spark, sf):
    coded = _coded(spark, sf)
    return coded.select("IDRSSD", *clean.columns_with_prefix(coded, "RIAD"))


@query("select_present", "id date:d total_assets:4", "panel", "SELECT id, date, total_assets FROM panel")
def select_present(spark, sf):
    chosen, _ = clean.select_present(fx.panel(spark, sf), ["id", "date", "total_assets", "never_reported"])
    return chosen


@query(
    "inf_to_null", "id date:d r:6", "panel",
    "SELECT id, date, total_equity / nullif(CASE WHEN month(date) = 1 THEN 0 ELSE total_assets END, 0) AS r FROM panel",
)
def inf_to_null(spark, sf):
    base = F.when(F.month("date") == 1, F.lit(0.0)).otherwise(F.col("total_assets"))
    return fx.panel(spark, sf).select("id", "date", S.ratio("total_equity", base).alias("r"))


@query("date_range_filter", "id date:d total_assets:4", "panel", "SELECT * FROM panel WHERE date BETWEEN DATE '1996-04-01' AND DATE '1999-10-01'")
def date_range_filter(spark, sf):
    return clean.date_range(fx.panel(spark, sf), "1996-04-01", "1999-10-01")


@query("year_filter", "id date:d total_assets:4", "panel", "SELECT id, date, exp(ln(total_assets)) AS total_assets FROM panel WHERE year(date) = 1998")
def year_filter(spark, sf):
    logged = fx.panel(spark, sf).select("id", "date", S.log_floor("total_assets").alias("l"))
    return clean.one_year(logged, 1998).select("id", "date", F.exp("l").alias("total_assets"))


@query("fill_constant", "id date:d level", "panel", "SELECT id, date, coalesce(CASE WHEN allowance_for_credit_losses IS NOT NULL THEN 'known' END, '-') AS level FROM panel")
def fill_constant(spark, sf):
    level = F.when(F.col("allowance_for_credit_losses").isNotNull(), "known")
    return clean.fill_constant(fx.panel(spark, sf).select("id", "date", level.alias("level")), "-", ["level"])


@query("net_flow", "id date:d net_charge_offs:4", "panel", "SELECT id, date, total_charge_offs - total_recoveries AS net_charge_offs FROM panel")
def net_flow(spark, sf):
    return clean.net_flow(fx.panel(spark, sf))


@query(
    "union_all_by_name", "id date:d dom_assets:4 con_assets:4", "panel",
    """SELECT id, date, CASE WHEN year(date) < 1998 THEN dom_assets END AS dom_assets, CASE WHEN year(date) >= 1998 THEN con_assets END AS con_assets FROM panel""",
)
def union_all_by_name(spark, sf):
    base = fx.panel(spark, sf)
    early = clean.date_range(base, None, "1997-12-31").select("id", "date", "dom_assets")
    late = clean.date_range(base, "1998-01-01", None).select("con_assets", "id", "date")
    return clean.union_by_name(early, late)


@query(
    "train_test_union", "split rows:i entities:i", "panel", "predictions",
    "SELECT split, count(*) AS rows, count(DISTINCT id) AS entities FROM predictions GROUP BY 1",
)
def train_test_union(spark, sf):
    rows = fx.predictions(spark, sf)
    stacked = clean.union_by_name(rows.filter("split = 'train'"), rows.filter("split = 'test'"))
    return stacked.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct("id").alias("entities"))


@query(
    "scalar_functions", "id date:d ratio fraction:6 spread:6 log:6 root:6 rounded:1 clipped:6 name display", "panel",
    """SELECT id, date, total_loans_and_leases / total_deposits AS ratio, interest_income / total_assets / 100 AS fraction,
       interest_income / total_assets - interest_expense / total_assets AS spread, CASE WHEN total_equity IS NULL THEN ln(1e-9) ELSE ln(total_equity) END AS log,
       sqrt(abs(net_income)) AS root, round(total_deposits / total_assets * 100, 1) AS rounded,
       CASE WHEN total_deposits / total_assets < 0.6 THEN 0.6 WHEN total_deposits / total_assets > 0.7 THEN 0.7 ELSE total_deposits / total_assets END AS clipped,
       'bank' || id AS name, CASE quarter(date) WHEN 1 THEN 'Deposit Ratio' WHEN 2 THEN 'Residential Loans (5y-15y) / Assets' ELSE 'other' END AS display FROM panel""",
)
def scalar_functions(spark, sf):
    q = F.quarter("date")
    variable = F.when(q == 1, "deposit_ratio").when(q == 2, "closed_end_first_liens_1_4_res_prop_5y_15y_to_assets").otherwise("other")
    share = S.ratio("total_deposits", "total_assets")
    return fx.panel(spark, sf).select(
        "id", "date", S.ratio("total_loans_and_leases", "total_deposits").alias("ratio"),
        (S.ratio("interest_income", "total_assets") / 100).alias("fraction"),
        (S.ratio("interest_income", "total_assets") - S.ratio("interest_expense", "total_assets")).alias("spread"),
        S.log_floor("total_equity").alias("log"), F.sqrt(F.abs("net_income")).alias("root"), F.round(share * 100, 1).alias("rounded"),
        S.clip(share, F.lit(0.6), F.lit(0.7)).alias("clipped"),
        S.normalise_name(F.concat(F.lit(" Bank \t "), "id")).alias("name"), S.display_name(variable).alias("display"),
    )


_RATIO_NAMES = list(plans.RATIOS) + [f"{c}_to_assets" for c in plans.TO_ASSETS] + ["net_interest_margin", *plans.TERMS, "dep_short_term_to_assets", "loans_short_term_to_assets", "log_total_assets"]


def _digits(name: str) -> str:
    # Deposits are whole thousands: their quotients end after few digits and could tie when rounded.
    return name if name == "loan_to_deposit_ratio" else f"{name}:{4 if name in plans.TERMS else 6}"


def _ratio_sql() -> str:
    parts = [f"{n} / nullif({d}, 0) AS {name}" for name, (n, d) in plans.RATIOS.items()]
    parts += [f"{c} / nullif(total_assets, 0) AS {c}_to_assets" for c in plans.TO_ASSETS]
    parts.append("(interest_income - interest_expense) / nullif(total_assets, 0) AS net_interest_margin")
    parts += [f"{' + '.join(cols)} AS {name}" for name, cols in plans.TERMS.items()]
    parts += [f"({' + '.join(plans.TERMS[t])}) / nullif(total_assets, 0) AS {t}_to_assets" for t in ("dep_short_term", "loans_short_term")]
    parts.append("ln(CASE WHEN coalesce(total_assets, 0) = 0 THEN 1e-9 ELSE total_assets END) AS log_total_assets")
    return "SELECT id, date, " + ", ".join(parts) + " FROM panel"


@query("ratio_suite", "id date:d " + " ".join(_digits(n) for n in _RATIO_NAMES), "panel", _ratio_sql())
def ratio_suite(spark, sf):
    return plans.ratio_suite(fx.panel(spark, sf))


@query(
    "quarter_effect", "quarter bank_id rows:i", "panel",
    "SELECT 'quarter_' || quarter(date) AS quarter, 'bank_id_' || id AS bank_id, count(*) AS rows FROM panel GROUP BY 1, 2",
)
def quarter_effect(spark, sf):
    return fx.panel(spark, sf).groupBy(quarter_name().alias("quarter"), entity_effect().alias("bank_id")).agg(F.count("*").alias("rows"))


@query("panel_sort", "id date:d total_assets:4", "panel", "SELECT id, date, total_assets FROM panel ORDER BY id, date")
def panel_sort(spark, sf):
    return fx.panel(spark, sf).orderBy("id", "date")


@query("head_tail_preview", "date:d gdp:4", "macro", """SELECT date, gdp FROM (SELECT *, row_number() OVER (ORDER BY date) AS a, row_number() OVER (ORDER BY date DESC) AS b FROM macro) WHERE a <= 5 OR b <= 5""")
def head_tail_preview(spark, sf):
    macro = fx.macro_levels(spark, sf).select("date", "gdp")
    return macro.orderBy("date").limit(5).unionByName(macro.orderBy(F.col("date").desc()).limit(5))
