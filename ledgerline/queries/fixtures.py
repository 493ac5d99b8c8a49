"""Panels, series, reports and predictions derived from the supplied tables.

Each derivation exists twice, as a DataFrame and as SQL text for the check. Amounts are rounded
where they are made, so that both engines continue from the same numbers.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.operators.windows import by_entity
from ledgerline.plans.panel import DEPOSIT_BUCKETS, LOAN_BUCKETS


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- entity x quarter panel of suppliers -------------------------------------------------

PANEL_SUMS = {
    "total_assets": "l_extendedprice",
    "total_loans_and_leases": "l_extendedprice * (1 - l_discount)",
    "total_deposits": "l_quantity * 1000",
    "total_equity": "CASE WHEN l_returnflag = 'A' THEN l_extendedprice END",
    "trading_assets": "CASE WHEN l_linestatus = 'O' THEN l_extendedprice END",
    "interest_income": "l_extendedprice * l_tax",
    "interest_expense": "l_extendedprice * l_discount",
    "net_interest_income": "l_extendedprice * (l_tax + l_discount)",
    "non_interest_income": "l_quantity * l_tax * 100",
    "non_interest_expense": "l_quantity * l_discount * 100",
    "net_income": "l_extendedprice * (l_tax - l_discount)",
    "total_charge_offs": "CASE WHEN l_returnflag = 'R' THEN l_extendedprice * l_tax END",
    "total_recoveries": "CASE WHEN l_returnflag = 'N' THEN l_extendedprice * l_tax END",
    "net_charge_offs": "CASE WHEN l_returnflag = 'R' THEN l_extendedprice * l_discount END",
    "npl": "CASE WHEN l_returnflag = 'R' THEN l_extendedprice END",
    "allowance_for_loan_and_lease_losses": "CASE WHEN l_linenumber = 1 THEN l_extendedprice END",
    "allowance_for_credit_losses": "CASE WHEN l_linenumber = 2 THEN l_extendedprice END",
    "provisions_for_credit_losses": "CASE WHEN l_linenumber = 3 THEN l_extendedprice END",
    "total_rwa": "CASE WHEN l_linenumber <= 4 THEN l_extendedprice END",
    "dep_demand": "CASE WHEN l_linenumber <= 3 THEN l_quantity * 1000 END",
    "dep_transaction_accounts": "CASE WHEN l_linenumber >= 5 THEN l_quantity * 1000 END",
    "dom_assets": "CASE WHEN l_returnflag = 'A' AND l_linenumber <= 3 THEN l_extendedprice END",
    "con_assets": "CASE WHEN l_returnflag = 'R' THEN l_extendedprice END",
    **{b: f"CASE WHEN l_linenumber IN ({1 + i % 7}, {1 + (i + 3) % 7}) THEN l_quantity * 1000 END" for i, b in enumerate(DEPOSIT_BUCKETS)},
    **{b: f"CASE WHEN l_linenumber IN ({1 + i % 7}, {1 + (i + 2) % 7}) THEN l_extendedprice END" for i, b in enumerate(LOAN_BUCKETS)},
}


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Dense panel: suppliers x quarters of the ship date."""
    rows = table(spark, sf, "lineitem")
    return rows.groupBy(
        F.col("l_suppkey").cast("string").alias("id"), F.expr("cast(date_trunc('quarter', l_shipdate) as date)").alias("date")
    ).agg(*[F.expr(f"round(sum({e}), 4)").alias(n) for n, e in PANEL_SUMS.items()])


PANEL_SQL = (
    "panel AS (SELECT CAST(l_suppkey AS VARCHAR) AS id, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS date, "
    + ", ".join(f"round(sum({e}), 4) AS {n}" for n, e in PANEL_SUMS.items())
    + " FROM lineitem GROUP BY 1, 2)"
)


NEW_PANEL_SUMS = ("total_assets", "total_deposits", "total_equity", "net_income")


def new_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Panel of other entities with the same measures: customers x quarters of the ship date."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id"), F.expr("cast(date_trunc('quarter', l_shipdate) as date)").alias("date")
    ).agg(*[F.expr(f"round(sum({PANEL_SUMS[n]}), 4)").alias(n) for n in NEW_PANEL_SUMS])


NEW_PANEL_SQL = (
    "new_panel AS (SELECT 'c' || CAST(o_custkey AS VARCHAR) AS id, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS date, "
    + ", ".join(f"round(sum({PANEL_SUMS[n]}), 4) AS {n}" for n in NEW_PANEL_SUMS)
    + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
)


# --- sparse panel of customers -----------------------------------------------------------


def thin(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse panel: customers x quarters of the order date, with some missing values."""
    rows = table(spark, sf, "orders")
    return rows.groupBy(
        F.col("o_custkey").cast("string").alias("id"), F.expr("cast(date_trunc('quarter', o_orderdate) as date)").alias("date")
    ).agg(
        F.expr("round(sum(case when o_orderstatus <> 'P' then o_totalprice end), 4)").alias("total_assets"),
        F.count("*").cast("double").alias("orders"),
    )


THIN_SQL = (
    "thin AS (SELECT CAST(o_custkey AS VARCHAR) AS id, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS date, "
    "round(sum(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END), 4) AS total_assets, "
    "CAST(count(*) AS DOUBLE) AS orders FROM orders GROUP BY 1, 2)"
)


# --- macro series and daily index --------------------------------------------------------
# Means of amounts in cents can end on the digit a rounding drops, where engines round ties
# differently; the divisors are chosen so that they do not.

MACRO_EXPRS = {
    "gdp": "sum(o_totalprice) / 100",
    "cpi": "avg(o_totalprice) / 1.7",
    "tbill_3m": "avg(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) / 85000",
    "tbill_1y": "avg(CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice END) / 85000",
    "tbill_10y": "avg(CASE WHEN o_orderpriority = '3-MEDIUM' THEN o_totalprice END) / 85000",
    "tbill_30y": "avg(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN o_totalprice END) / 85000",
    "cons_sentiment": "max(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END) / 1700",
    "unemployment": "avg(CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice END) / 85000",
    "corp_bond_spread": "avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) / 119000",
    "household_delinq": "avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) / 102000",
    "vix": "min(o_totalprice)",
}
# Two series pause in some quarters, so that growth has to look past a missing value.
MACRO_PAUSES = {"cons_sentiment": 3, "vix": 2}


def macro_levels(spark: SparkSession, sf: str) -> DataFrame:
    """One row per quarter of the order date with a column per macro series."""
    rows = table(spark, sf, "orders")
    wide = rows.groupBy(F.expr("cast(date_trunc('quarter', o_orderdate) as date)").alias("date")).agg(
        *[F.expr(f"round({e}, 4)").alias(n) for n, e in MACRO_EXPRS.items()]
    )
    return wide.withColumns(
        {n: F.when(F.quarter("date") != q, F.col(n)) for n, q in MACRO_PAUSES.items()}
    )


def macro_long(spark: SparkSession, sf: str) -> DataFrame:
    return macro_levels(spark, sf).unpivot("date", list(MACRO_EXPRS), "series", "value").filter(F.col("value").isNotNull() | (F.col("series") != "vix"))


MACRO_SQL = (
    "macro AS (SELECT date, "
    + ", ".join(
        f"CASE WHEN quarter(date) <> {MACRO_PAUSES[n]} THEN {n} END AS {n}" if n in MACRO_PAUSES else n for n in MACRO_EXPRS
    )
    + " FROM (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS date, "
    + ", ".join(f"round({e}, 4) AS {n}" for n, e in MACRO_EXPRS.items())
    + " FROM orders GROUP BY 1))"
)
# The same rows in long form: missing vix rows are absent, missing sentiment rows are NULL.
MACRO_LONG_SQL = (
    "macro_long AS (" + " UNION ALL ".join(f"SELECT '{n}' AS series, date, {n} AS value FROM macro" for n in MACRO_EXPRS if n != "vix")
    + " UNION ALL SELECT 'vix', date, vix FROM macro WHERE vix IS NOT NULL)"
)


def daily_index(spark: SparkSession, sf: str) -> DataFrame:
    """Daily close: mean order value per day."""
    rows = table(spark, sf, "orders")
    return rows.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.avg("o_totalprice") / 1.7, 4).alias("close"))


DAILY_SQL = "daily AS (SELECT CAST(o_orderdate AS DATE) AS day, round(avg(o_totalprice) / 1.7, 4) AS close FROM orders GROUP BY 1)"


# --- event list --------------------------------------------------------------------------


def named_thin(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("bank_name"))
    return thin(spark, sf).join(names, "id")


def event_list(spark: SparkSession, sf: str) -> DataFrame:
    """Customers in debt: upper-case name with blanks inside, on the days of their orders.

    Half of them carry a suffix and so match nobody.
    """
    debt = table(spark, sf, "customer").filter("c_acctbal < 0")
    days = table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day")).distinct()
    name = F.upper(F.replace("c_name", F.lit("#"), F.lit("  # ")))
    return debt.join(days, debt.c_custkey == days.o_custkey).select(
        F.when(F.col("c_custkey") % 2 == 0, name).otherwise(F.concat(name, F.lit(" II"))).alias("name"), "day"
    )


EVENTS_SQL = """named AS (SELECT t.*, c_name AS bank_name FROM thin t JOIN customer ON CAST(c_custkey AS VARCHAR) = t.id),
events_ AS (SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN upper(replace(c_name, '#', '  # ')) ELSE upper(replace(c_name, '#', '  # ')) || ' II' END AS name,
  CAST(o_orderdate AS DATE) AS day FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal < 0),
event_keys AS (SELECT DISTINCT regexp_replace(lower(name), '\\s+', '', 'g') AS k, CAST(date_trunc('quarter', day) AS DATE) AS q FROM events_)"""


# --- predictions -------------------------------------------------------------------------

PREDICTION_CUT = "2000-01-01"


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Three naive forecasts of a ratio: last value, value before it, and a damped one."""
    w = by_entity()
    base = panel(spark, sf).select("id", "date", (F.col("interest_income") / F.col("total_assets")).alias("label"))
    lagged = base.withColumns({"a": F.lag("label", 1).over(w), "b": F.lag("label", 2).over(w)})
    cells = F.array(
        F.struct(F.lit("last").alias("model"), F.col("a").alias("prediction")),
        F.struct(F.lit("before_RFE").alias("model"), F.col("b").alias("prediction")),
        F.struct(F.lit("damped").alias("model"), (F.col("a") * 0.5 + 0.02).alias("prediction")),
    )
    split = F.when(F.col("date") < F.lit(PREDICTION_CUT).cast("date"), "train").otherwise("test")
    return lagged.filter(F.col("b").isNotNull()).select(
        F.lit("income").alias("target"), F.lit(1).alias("horizon"), F.inline(cells), split.alias("split"), "id", "date", "label"
    )


PREDICTIONS_SQL = f"""pl AS (SELECT id, date, label, lag(label, 1) OVER w AS a, lag(label, 2) OVER w AS b
  FROM (SELECT id, date, interest_income / total_assets AS label FROM panel) WINDOW w AS (PARTITION BY id ORDER BY date)),
predictions AS (SELECT 'income' AS target, 1 AS horizon, model, CASE WHEN date < DATE '{PREDICTION_CUT}' THEN 'train' ELSE 'test' END AS split, id, date, label, prediction
  FROM (SELECT 'last' AS model, id, date, label, a AS prediction, b FROM pl UNION ALL SELECT 'before_RFE', id, date, label, b, b FROM pl
        UNION ALL SELECT 'damped', id, date, label, a * 0.5 + 0.02, b FROM pl) WHERE b IS NOT NULL)"""


# --- report files ------------------------------------------------------------------------

# member name pattern, columns: code -> (description, panel expression)
_MEMBERS = [
    ("Schedule ENT {d}.txt", {"RCON9999": ("Reporting date", "date_format({end}, 'yyyyMMdd')"), "RSSD9017": ("Name", "concat('Bank ', id)")}),
    (
        "Schedule RC {d}(1 of 2).txt",
        {"RCON2170": ('"TOTAL ASSETS"', "cast(dom_assets as string)"), "RCFD2170": ("Total assets", "cast(con_assets as string)"), "RCON2122": ("Total loans", "cast(total_loans_and_leases as string)")},
    ),
    ("Schedule RC {d}(2 of 2).txt", {"RCON2200": ("Total deposits", "cast(total_deposits as string)"), "RCON2122": ("Loans again", "cast(total_deposits as string)")}),
    ("Schedule RI {d}.txt", {"RIAD4107": ("Interest income", "cast({ytd} as string)"), "RCON2170": ("12345", "cast(total_assets as string)"), "RIAD4340": ("Net income", "cast(net_income as string)")}),
]
# In fourth quarters part 2 of 2 was never delivered.
LOST_PART_SQL = "quarter(date) = 4"
_END = "date_sub(add_months(date, 3), 1)"


def _member(i: int) -> str:
    before, after = _MEMBERS[i][0].split("{d}")
    return f"concat('{before}', date_format({_END}, 'MMddyyyy'), '{after}')"


def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of tab-separated report members, an archive per quarter; income is year to date."""
    base = panel(spark, sf).select(
        "id", "date", "dom_assets", "con_assets", "total_assets", "total_loans_and_leases", "total_deposits", "net_income", "interest_income"
    )
    running = F.sum("interest_income").over(Window.partitionBy("id", F.year("date")).orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    base = base.withColumn("ytd", F.round(running, 4))
    fmt = lambda e: e.format(end=_END, ytd="ytd")
    data = []
    for i, (_, columns) in enumerate(_MEMBERS):
        values = ", ".join(f"coalesce({fmt(e)}, '')" for _, e in columns.values())
        data.append(f"struct({_member(i)} as member, {i} as member_no, concat_ws('\t', id, {values}) as line)")
    heads = []
    for i, (_, columns) in enumerate(_MEMBERS):
        codes = "\\t".join(["IDRSSD", *columns])
        texts = "\\t".join(["", *[d for d, _ in columns.values()]])
        for no, line in ((0, codes), (1, texts)):
            heads.append(f"struct({_member(i)} as member, {i} as member_no, {no}L as line_no, '{line}' as line)")
    archive = F.expr(f"concat('Reports ', date_format({_END}, 'yyyyMMdd'), '.zip')").alias("archive")
    body = base.select(archive, F.col("date"), (F.col("id").cast("bigint") + 2).alias("line_no"), F.expr(f"inline(array({', '.join(data)}))"))
    top = base.select("date").distinct().select(archive, F.col("date"), F.expr(f"inline(array({', '.join(heads)}))"))
    return (
        body.unionByName(top)
        .filter(f"not (member_no = 2 and {LOST_PART_SQL})")
        .select("archive", "member_no", "member", "line_no", "line")
    )


def _zipped(members: dict[str, bytes]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as out:
        for name, content in members.items():
            out.writestr(name, content)
    return buffer.getvalue()


def _packer(root: str):
    def pack(lines: pd.DataFrame) -> pd.DataFrame:
        """Write one zip archive of a folder and year, each member preceded by its two header lines."""
        head = "IDRSSD\tRCON2170\n\tTotal assets\n"
        members = {m: (head + "\n".join(part) + "\n").encode() for m, part in lines.groupby("member", sort=True)["line"]}
        system, folder = fs.FileSystem.from_uri(root)
        path = f"{folder}/{lines['path'].iloc[0]}"
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(path) as out:
            out.write(_zipped({**members, "readme.md": b"not a report"}))
        return pd.DataFrame({"path": [path]})

    return pack


def land_archives(spark: SparkSession, sf: str, root: str) -> None:
    """Write the panel's asset lines as zip files below ``root``: a folder, an archive per year, a member per quarter.

    Spark tasks write the files; a repeated task writes the same file again.
    """
    folder = "CASE WHEN quarter(date) = 4 THEN 'old' ELSE 'new' END"
    lines = panel(spark, sf).select(
        F.expr(f"concat({folder}, '/Reports ', year(date), '.zip')").alias("path"),
        F.expr(f"concat('RC/Schedule RC ', date_format({_END}, 'MMddyyyy'), '.txt')").alias("member"),
        F.concat_ws("\t", "id", F.col("total_assets").cast("string")).alias("line"),
    )
    lines.groupBy("path").applyInPandas(_packer(root if "://" in root or root.startswith("file:") else f"file://{root}"), "path string").write.format("noop").mode("overwrite").save()


def _report_packer(root: str):
    def pack(lines: pd.DataFrame) -> pd.DataFrame:
        """Write the members of one report archive, and beside each fourth quarter's an archive that is damaged."""
        ordered = lines.sort_values(["member_no", "line_no"])
        members = {m: ("\n".join(part) + "\n").encode() for m, part in ordered.groupby("member", sort=False)["line"]}
        system, folder = fs.FileSystem.from_uri(root)
        system.create_dir(folder, recursive=True)
        name = lines["archive"].iloc[0]
        files = {name: _zipped(members)}
        if name.endswith("1231.zip"):
            files[f"Broken {name}"] = b"not an archive, but long enough to look for a directory in"
        for file, content in files.items():
            with system.open_output_stream(f"{folder}/{file}") as out:
                out.write(content)
        return pd.DataFrame({"path": [name]})

    return pack


def land_reports(spark: SparkSession, sf: str, root: str) -> None:
    """Write the report lines as zip files below ``root``, an archive per quarter; Spark tasks write the files."""
    target = root if "://" in root or root.startswith("file:") else f"file://{root}"
    report_lines(spark, sf).groupBy("archive").applyInPandas(_report_packer(target), "path string").write.format("noop").mode("overwrite").save()


def _pack_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """An archive per batch: names with an even key in a Latin-1 member, the others in a UTF-8 one."""
    for number, batch in enumerate(batches):
        if not batch.empty:
            text = [(k, "latin-1" if k % 2 == 0 else "utf-8", f"{k}\t{t}\n") for k, t in zip(batch["k"], batch["text"])]
            members = {f"{code}.txt": "".join(t for _, c, t in text if c == code).encode(code) for code in ("latin-1", "utf-8")}
            yield pd.DataFrame({"path": [f"names-{number}-{batch['k'].iloc[0]}.zip"], "content": [_zipped(members)]})


def packed_names(spark: SparkSession, sf: str) -> DataFrame:
    """Customer names with accents packed by Spark tasks, as (path, content)."""
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.concat("c_name", F.lit(" é ü")).alias("text"))
    return names.mapInPandas(_pack_names, "path string, content binary")


SQL = {
    "panel": PANEL_SQL,
    "new_panel": NEW_PANEL_SQL,
    "thin": THIN_SQL,
    "macro": MACRO_SQL,
    "macro_long": MACRO_LONG_SQL,
    "daily": DAILY_SQL,
    "events": EVENTS_SQL,
    "predictions": PREDICTIONS_SQL,
}


SQL["index_q"] = """index_q AS (SELECT CAST(date_trunc('quarter', day) + INTERVAL 3 MONTH AS DATE) AS date, arg_min(close, day) AS sp500 FROM daily GROUP BY 1)"""

# --- derivations of the report queries ------------------------------------------------------

END = "(date + INTERVAL 3 MONTH - INTERVAL 1 DAY)"
D8 = f"strftime({END}, '%m%d%Y')"
ARCHIVE = f"'Reports ' || strftime({END}, '%Y%m%d') || '.zip'"


def _cell(no: int, member: str, code: str, value: str, lost: bool = False) -> str:
    name = member.replace("{d}", "' || d8 || '")
    where = f" AND NOT ({LOST_PART_SQL})" if lost else ""
    return f"SELECT archive, '{name}' AS member, {no} AS member_no, id, date, d8, '{code}' AS code, CAST({value} AS DOUBLE) AS num, FALSE AS is_text FROM rep WHERE {value} IS NOT NULL{where}"


RC1, RC2 = "Schedule RC {d}(1 of 2).txt", "Schedule RC {d}(2 of 2).txt"
RI, ENT = "Schedule RI {d}.txt", "Schedule ENT {d}.txt"
SQL["rep"] = f"""rep AS (SELECT *, {ARCHIVE} AS archive, {D8} AS d8, CAST(strftime({END}, '%Y%m%d') AS DOUBLE) AS day8,
  round(sum(interest_income) OVER (PARTITION BY id, year(date) ORDER BY date ROWS UNBOUNDED PRECEDING), 4) AS ytd FROM panel)"""
SQL["cells"] = "cells AS (" + " UNION ALL ".join(
    [
        _cell(0, ENT, "RCON9999", "day8"),
        "SELECT archive, 'Schedule ENT ' || d8 || '.txt', 0, id, date, d8, 'RSSD9017', NULL, TRUE FROM rep",
        _cell(1, RC1, "RCON2170", "dom_assets"),
        _cell(1, RC1, "RCFD2170", "con_assets"),
        _cell(1, RC1, "RCON2122", "total_loans_and_leases"),
        _cell(2, RC2, "RCON2200", "total_deposits", lost=True),
        _cell(2, RC2, "RCON2122", "total_deposits", lost=True),
        _cell(3, RI, "RIAD4107", "ytd"),
        _cell(3, RI, "RCON2170", "total_assets"),
        _cell(3, RI, "RIAD4340", "net_income"),
    ]
) + ")"
# Table names after the split parts are put together.
SQL["tabled"] = """tabled AS (SELECT *, CASE WHEN member_no IN (1, 2) THEN 'Schedule RC ' || d8 || CASE WHEN quarter(date) = 4 THEN '_Part_1_of_2' ELSE '_Combined_2parts' END
  ELSE replace(member, '.txt', '') END AS tab FROM cells WHERE NOT (member_no = 2 AND code = 'RCON2122'))"""
# The asset item is in two tables: the combined one comes first, an orphan part comes last.
SQL["merged"] = """merged AS (SELECT *, CASE WHEN code = 'RCON2170' AND (CASE WHEN quarter(date) = 4 THEN member_no = 1 ELSE member_no = 3 END)
  THEN code || '_' || tab ELSE code END AS col FROM tabled)"""


def with_(*names: str) -> str:
    """WITH clause of named derivations; an entry that holds ``AS`` is SQL text used as given."""
    unknown = [n for n in names if n not in SQL and " AS " not in n]
    if unknown:
        raise ValueError(f"unknown derivations {unknown}")
    return "WITH " + ",\n".join(SQL.get(n, n) for n in names) + "\n"
