"""Queries on scans, sources and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.plans.imports import import_archives
from ledgerline.plans.panel import entity_panel
from ledgerline.queries import fixtures as fx
from ledgerline.queries.registry import query
from ledgerline.session import materialize, scratch_path
from ledgerline.sources import archives, files, reports


@query(
    "archive_scan", "archive member lines:i total:4", "panel",
    f"""SELECT CASE WHEN quarter(date) = 4 THEN 'old' ELSE 'new' END || '/Reports ' || year(date) || '.zip' AS archive, 'RC/Schedule RC ' || {fx.D8} || '.txt' AS member,
       count(*) AS lines, sum(total_assets) AS total FROM panel GROUP BY 1, 2""",
)
def archive_scan(spark, sf):
    root = scratch_path(spark, "landing")
    fx.land_archives(spark, sf, root)
    data = archives.member_lines(archives.read_archives(spark, root)).filter("line_no >= 2")
    value = S.to_number(F.get(reports.cells(F.col("line")), F.lit(1)))
    # Two folders hold archives of the same name.
    name = F.concat_ws("/", F.slice(F.split("archive", "/"), -2, 2)).alias("archive")
    return data.groupBy(name, "member").agg(F.count("*").alias("lines"), F.sum(value).alias("total"))


# All five outputs of an import in one table: what each of them says about archives and names.
_IMPORTED = """broken AS (SELECT DISTINCT 'Broken ' || archive AS archive FROM rep WHERE quarter(date) = 4),
member_shapes AS (SELECT archive, member, member_no, count(DISTINCT id) AS rows FROM (SELECT archive, member, member_no, id FROM cells
  UNION SELECT archive, 'Schedule RC ' || d8 || '(1 of 2).txt', 1, id FROM rep) GROUP BY ALL),
member_metrics AS (SELECT archive, member AS name, date, count(DISTINCT id) AS entities, count(DISTINCT id) * CASE WHEN member_no IN (0, 2) THEN 2 ELSE 3 END AS cells, count(*) AS known
  FROM cells GROUP BY archive, member, member_no, date),
table_metrics AS (SELECT archive, tab AS name, date, count(DISTINCT id) AS entities, count(DISTINCT id) * 4 AS cells, count(*) AS known FROM tabled WHERE member_no IN (1, 2) AND quarter(date) <> 4 GROUP BY ALL),
described AS (SELECT code, arg_min(description, archive || no) AS description FROM (SELECT DISTINCT archive, date FROM rep) CROSS JOIN (VALUES
  ('0', 'RCON9999', 'Reporting date'), ('0', 'RSSD9017', 'Name'), ('1', 'RCON2170', 'TOTAL ASSETS'), ('1', 'RCFD2170', 'Total assets'), ('1', 'RCON2122', 'Total loans'), ('2', 'RCON2200', 'Total deposits'),
  ('2', 'RCON2122', 'Loans again'), ('3', 'RIAD4107', 'Interest income'), ('3', 'RCON2170', '12345'), ('3', 'RIAD4340', 'Net income')) AS v(no, code, description)
  WHERE NOT regexp_matches(description, '^[0-9]+$') AND NOT (no = '2' AND quarter(date) = 4) GROUP BY code)"""


@query(
    "import_job", "output archive name a:4 b:4 c:4 text", "panel", "rep", "cells", "tabled", _IMPORTED,
    """SELECT 'panel' AS output, archive, id AS name, CASE WHEN quarter(date) = 4 THEN total_assets ELSE dom_assets END AS a, total_loans_and_leases AS b, CASE WHEN quarter(date) <> 4 THEN total_deposits END AS c, 'Bank ' || id AS text FROM rep
       UNION ALL SELECT 'shapes', archive, member, rows, 1 + CASE member_no WHEN 0 THEN 2 WHEN 2 THEN 2 ELSE 3 END, NULL, NULL FROM member_shapes
       UNION ALL SELECT 'metrics', archive, name, entities, cells, cells - known, 'Q' || quarter(date) || ' ' || year(date) FROM (SELECT * FROM member_metrics UNION ALL SELECT * FROM table_metrics)
       UNION ALL SELECT 'codes', NULL, code, NULL, NULL, NULL, description FROM described
       UNION ALL SELECT 'problems', archive, NULL, NULL, NULL, NULL, 'bad zip file' FROM broken""",
)
def import_job(spark, sf):
    """Archives with split members and damaged ones beside them go through the whole import."""
    root, out = scratch_path(spark, "landing"), scratch_path(spark, "imported")
    fx.land_reports(spark, sf, root)
    import_archives(spark, root, out, ["RCON2170", "RCON2122", "RCON2200", "RSSD9017"])
    log = {n: spark.read.option("header", True).csv(f"{out}/logs/{n}") for n in ("shapes", "metrics", "codes", "problems")}
    parts = {
        "panel": (spark.read.parquet(f"{out}/panel"), "id", ["RCON2170", "RCON2122", "RCON2200"], "RSSD9017"),
        "shapes": (log["shapes"], "member", ["rows", "cols"], None),
        "metrics": (log["metrics"], "member", ["entities", "cells", "missing"], "quarter"),
        "codes": (log["codes"].withColumn("archive", F.lit(None).cast("string")), "code", [], "description"),
        "problems": (log["problems"], "member", [], "problem"),
    }
    none = F.lit(None)
    tables = []
    for output, (rows, name, numbers, text) in parts.items():
        values = [S.to_number(numbers[i]) if i < len(numbers) else none.cast("double") for i in range(3)]
        tables.append(rows.select(
            F.lit(output).alias("output"), archives.base_name("archive").alias("archive"), F.col(name).alias("name"),
            *[v.alias(n) for v, n in zip(values, "abc")], (F.col(text) if text else none.cast("string")).alias("text"),
        ))
    return reduce(DataFrame.unionByName, tables)


def _lines(spark, sf):
    return fx.report_lines(spark, sf)


def _cells(spark, sf):
    return reports.melt(reports.rows(_lines(spark, sf)))


@query(
    "tsv_parse", "member code n:i total:4", "panel", "rep", "cells",
    "SELECT member, code, count(*) AS n, sum(num) AS total FROM cells GROUP BY 1, 2",
)
def tsv_parse(spark, sf):
    return _cells(spark, sf).groupBy("member", "code").agg(F.count("*").alias("n"), F.sum(S.to_number("value")).alias("total"))


@query("encoding_fallback", "k:i text", "SELECT c_custkey AS k, c_name || ' é ü' AS text FROM customer")
def encoding_fallback(spark, sf):
    packed = fx.packed_names(spark, sf)
    data = archives.member_lines(archives.scan_archives(packed)).select(F.split("line", "\t").alias("c"))
    return data.select(F.get("c", F.lit(0)).alias("k"), F.get("c", F.lit(1)).alias("text"))


@query(
    "code_dictionary", "code description", "panel", "rep",
    """SELECT code, arg_min(description, archive || no) AS description FROM (SELECT DISTINCT archive, date FROM rep) CROSS JOIN (VALUES
      ('0', 'RCON9999', 'Reporting date'), ('0', 'RSSD9017', 'Name'), ('1', 'RCON2170', 'TOTAL ASSETS'), ('1', 'RCFD2170', 'Total assets'),
      ('1', 'RCON2122', 'Total loans'), ('2', 'RCON2200', 'Total deposits'), ('2', 'RCON2122', 'Loans again'), ('3', 'RIAD4107', 'Interest income'),
      ('3', 'RCON2170', '12345'), ('3', 'RIAD4340', 'Net income')) AS v(no, code, description)
      WHERE NOT regexp_matches(description, '^[0-9]+$') AND NOT (no = '2' AND quarter(date) = 4) GROUP BY code""",
)
def code_dictionary(spark, sf):
    return reports.code_dictionary(_lines(spark, sf))


@query(
    "filename_quarter", "quarter files:i",
    """SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'Unknown' ELSE 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) END AS quarter, count(*) AS files
       FROM orders GROUP BY 1""",
)
def filename_quarter(spark, sf):
    orders = fx.table(spark, sf, "orders")
    name = (
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("list 99999999 "), F.date_format("o_orderdate", "yyMMdd"), F.lit(".txt")))
        .when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("x00 "), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(" 11111111.txt")))
        .otherwise(F.concat(F.lit("x 99999999 "), F.date_format("o_orderdate", "MMddyyyy"), F.lit(".txt")))
    )
    return orders.select(S.filename_quarter(name).alias("quarter")).groupBy("quarter").agg(F.count("*").alias("files"))


@query(
    "split_part_detect", "k:i base part:i total:i",
    """SELECT c_custkey AS k, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS base, c_custkey % 3 AS part,
       CASE WHEN c_custkey % 3 > 0 THEN 2 ELSE 0 END AS total FROM customer""",
)
def split_part_detect(spark, sf):
    k = F.col("c_custkey")
    name = F.when(k % 3 > 0, F.concat("c_name", F.lit(" ("), k % 3, F.lit(" OF 2).TXT"))).otherwise(F.concat("c_name", F.lit(".txt")))
    return fx.table(spark, sf, "customer").select(k.alias("k"), S.split_part(name).alias("p")).select(
        "k", "p.base", F.coalesce("p.part", F.lit(0)).alias("part"), F.coalesce("p.total", F.lit(0)).alias("total")
    )


@query(
    "split_part_combine", "archive table code n:i total:4", "panel", "rep", "cells", "tabled",
    'SELECT archive, tab AS "table", code, count(*) AS n, sum(num) AS total FROM tabled GROUP BY 1, 2, 3',
)
def split_part_combine(spark, sf):
    heads = materialize(reports.headers(_lines(spark, sf)), "headers")
    combined = reports.combine_parts(_cells(spark, sf), reports.table_columns(heads))
    return combined.groupBy("archive", "table", "code").agg(F.count("*").alias("n"), F.sum(S.to_number("value")).alias("total"))


@query(
    "schedule_merge", "archive column n:i total:4", "panel", "rep", "cells", "tabled", "merged",
    'SELECT archive, col AS "column", count(*) AS n, sum(num) AS total FROM merged GROUP BY 1, 2',
)
def schedule_merge(spark, sf):
    merged = reports.read_reports(_lines(spark, sf))
    return merged.groupBy("archive", "column").agg(F.count("*").alias("n"), F.sum(S.to_number("value")).alias("total"))


@query(
    "full_outer_fold", "archive id RCON2170:4 RCON2122:4 RCON2200:4 RIAD4107:4 RSSD9017", "panel", "rep",
    """SELECT archive, id, CASE WHEN quarter(date) = 4 THEN total_assets ELSE dom_assets END AS "RCON2170", total_loans_and_leases AS "RCON2122",
       CASE WHEN quarter(date) <> 4 THEN total_deposits END AS "RCON2200", ytd AS "RIAD4107", 'Bank ' || id AS "RSSD9017" FROM rep""",
)
def full_outer_fold(spark, sf):
    wide = reports.widen(reports.read_reports(_lines(spark, sf)), ["RCON2170", "RCON2122", "RCON2200", "RIAD4107", "RSSD9017"])
    return wide.withColumns({c: S.to_number(c) for c in ("RCON2170", "RCON2122", "RCON2200", "RIAD4107")})


def year_files(spark, sf) -> dict[int, str]:
    """The panel as one file per year, each with its own columns."""
    full = fx.panel(spark, sf).select("id", "date", "dom_assets", "con_assets", "total_assets")
    root = scratch_path(spark, "years")
    stored = f"{root}/all"
    files.write_parquet(full.withColumn("y", F.year("date")), stored, ["y"])
    out = {}
    years = [r[0] for r in spark.read.parquet(stored).select("y").distinct().collect()]
    for y in sorted(years):
        one = spark.read.parquet(stored).filter(F.col("y") == y).drop("y")
        dropped = ["con_assets"] if y <= 1996 else ["dom_assets"] if y >= 2000 else ["date"] if y == 1998 else []
        files.write_parquet(one.drop(*dropped), f"{root}/reports/{y}")
        out[y] = f"{root}/reports/{y}"
    return out


DESIRED = ["id", "date", "dom_assets", "con_assets", "total_assets", "never_reported"]


@query(
    "evolving_parquet_scan", "id date:d dom_assets:4 con_assets:4 total_assets:4", "panel",
    """SELECT id, date, CASE WHEN year(date) < 2000 THEN dom_assets END AS dom_assets, CASE WHEN year(date) > 1996 THEN con_assets END AS con_assets, total_assets
       FROM panel WHERE year(date) <> 1998""",
)
def evolving_parquet_scan(spark, sf):
    return files.read_evolving(spark, list(year_files(spark, sf).values()), DESIRED, ["id", "date"])


def _available(spark, sf):
    """(file, code) pairs: which measures a year reports at all, from the non-missing cells."""
    years = fx.panel(spark, sf).select(F.year("date").cast("string").alias("file"), "dom_assets", "con_assets", "total_assets")
    keep = years.withColumns(
        {
            "dom_assets": F.when(F.col("file") < "2000", F.col("dom_assets")),
            "con_assets": F.when(F.col("file") > "1996", F.col("con_assets")),
        }
    )
    long = keep.unpivot("file", ["dom_assets", "con_assets", "total_assets"], "code", "value")
    return long.filter("value is not null").select("file", "code").distinct()


_AVAILABLE_SQL = """avail AS (SELECT DISTINCT CAST(year(date) AS VARCHAR) AS file, code FROM (
  SELECT date, 'dom_assets' AS code FROM panel WHERE dom_assets IS NOT NULL AND year(date) < 2000 UNION ALL
  SELECT date, 'con_assets' FROM panel WHERE con_assets IS NOT NULL AND year(date) > 1996 UNION ALL
  SELECT date, 'total_assets' FROM panel WHERE total_assets IS NOT NULL))"""


@query(
    "missing_codes_report", "file code", "panel", _AVAILABLE_SQL,
    """SELECT f.file, w.code FROM (SELECT DISTINCT file FROM avail) f CROSS JOIN (VALUES ('dom_assets'), ('con_assets'), ('total_assets'), ('never_reported')) w(code)
       EXCEPT SELECT file, code FROM avail""",
)
def missing_codes_report(spark, sf):
    return files.missing_codes(_available(spark, sf), ["dom_assets", "con_assets", "total_assets", "never_reported"])


@query("codes_seen", "code", "panel", _AVAILABLE_SQL, "SELECT DISTINCT code FROM avail")
def codes_seen(spark, sf):
    return files.codes_seen(_available(spark, sf))


@query(
    "parquet_scan", "o_orderpriority n:i total:4",
    "SELECT o_orderpriority, count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1",
)
def parquet_scan(spark, sf):
    orders = fx.table(spark, sf, "orders").filter(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    return orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


@query("csv_scan", "name day:d", "thin", "events", "SELECT name, day FROM events_")
def csv_scan(spark, sf):
    path = scratch_path(spark, "events")
    listed = fx.event_list(spark, sf).select(F.col("name").alias("NAME"), F.lit("closed").alias("STATUS"), F.col("day").alias("FAILDATE"))
    files.write_csv(listed, path)
    return files.read_events(spark, path)


@query("parquet_sink", "year:i rows:i total:4", "panel", "SELECT year(date) AS year, count(*) AS rows, sum(total_assets) AS total FROM panel GROUP BY 1")
def parquet_sink(spark, sf):
    path = scratch_path(spark, "panel")
    files.write_parquet(fx.panel(spark, sf).withColumn("year", F.year("date")), path, ["year"], codec="gzip")
    stored = spark.read.parquet(path)
    return stored.groupBy("year").agg(F.count("*").alias("rows"), F.sum("total_assets").alias("total"))


@query("csv_sink", "member rows:i cols:i", "panel", "rep", "cells", """SELECT member, count(DISTINCT id) AS rows, 1 + CASE member_no WHEN 0 THEN 2 WHEN 2 THEN 2 ELSE 3 END AS cols FROM (
    SELECT member, member_no, id FROM cells UNION SELECT 'Schedule RC ' || d8 || '(1 of 2).txt', 1, id FROM rep) GROUP BY member, member_no""")
def csv_sink(spark, sf):
    path = scratch_path(spark, "shapes")
    files.write_csv(reports.file_shapes(_lines(spark, sf)), path)
    return spark.read.option("header", True).csv(path)


@query("file_shapes", "member rows:i cols:i", "panel", "rep", "cells", """SELECT member, count(DISTINCT id) AS rows, 1 + CASE member_no WHEN 0 THEN 2 WHEN 2 THEN 2 ELSE 3 END AS cols FROM (
    SELECT member, member_no, id FROM cells UNION SELECT 'Schedule RC ' || d8 || '(1 of 2).txt', 1, id FROM rep) GROUP BY member, member_no""")
def file_shapes(spark, sf):
    return reports.file_shapes(_lines(spark, sf))


@query(
    "file_metrics", "member quarter entities:i non_numeric_ids:i cells:i missing:i missing_pct:1", "panel", "rep", "cells",
    """SELECT *, round(missing * 100.0 / cells, 1) AS missing_pct FROM (SELECT member, 'Q' || quarter(date) || ' ' || year(date) AS quarter, count(DISTINCT id) AS entities,
       0 AS non_numeric_ids, count(DISTINCT id) * CASE WHEN member_no IN (0, 2) THEN 2 ELSE 3 END AS cells,
       count(DISTINCT id) * CASE WHEN member_no IN (0, 2) THEN 2 ELSE 3 END - count(*) AS missing FROM cells GROUP BY member, member_no, date)""",
)
def file_metrics(spark, sf):
    return reports.file_metrics(reports.rows(_lines(spark, sf)))


@query(
    "entity_panel", "id date:d bank_name total_assets:4 total_loans_and_leases:4 total_deposits:4 interest_income:4 net_income:4", "panel", "rep",
    """SELECT id, date, 'Bank ' || id AS bank_name, CASE WHEN quarter(date) = 4 THEN total_assets ELSE coalesce(dom_assets, con_assets) END AS total_assets,
       total_loans_and_leases, CASE WHEN quarter(date) <> 4 THEN total_deposits END AS total_deposits,
       coalesce(ytd - lag(ytd) OVER w, ytd) AS interest_income, coalesce(net_income - lag(net_income) OVER w, net_income) AS net_income
       FROM rep WINDOW w AS (PARTITION BY id, year(date) ORDER BY date)""",
)
def entity_panel_query(spark, sf):
    codes = ["RCON9999", "RSSD9017", "RCON2170", "RCFD2170", "RCON2122", "RCON2200", "RIAD4107", "RIAD4340"]
    wide = reports.widen(reports.read_reports(_lines(spark, sf)), codes).withColumnRenamed("id", "IDRSSD")
    return entity_panel(wide, [F.col("archive")])
