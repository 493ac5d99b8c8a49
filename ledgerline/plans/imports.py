"""Import of a folder of report archives: panel files and their logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.codes import REPORT_CODES
from ledgerline.operators.joins import checked_broadcast
from ledgerline.session import materialize
from ledgerline.sources import archives, files, reports

_FILE = ["path", "length", "modificationTime"]


def _key(path: str) -> Column:
    """Folder name of an archive: paths hold characters that folder names may not, at any length."""
    return F.md5(path).alias("archive_key")


def _finished(spark: SparkSession, out: str) -> DataFrame | None:
    """Files in the form in which they were last read, and the number of the import that did."""
    try:
        marks = spark.read.parquet(f"{out}/finished")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return marks.groupBy("path").agg(F.max_by(F.struct("length", "modificationTime"), "number").alias("f"), F.max("number").alias("number")).select("path", "f.*", "number")


def new_archives(spark: SparkSession, landing: str, out: str) -> DataFrame:
    """Files below ``landing`` that no finished import has read in their present form."""
    landed, finished = archives.archive_files(spark, landing), _finished(spark, out)
    return landed if finished is None else landed.join(finished, _FILE, "left_anti")


def import_archives(spark: SparkSession, landing: str, out: str, codes: Sequence[str] = tuple(REPORT_CODES)) -> None:
    """Read the archives below ``landing`` that are new or changed and bring ``out`` up to date:

    ``panel``, one row for each archive and entity with the wanted codes; ``logs/metrics``, of members and of tables
    put together from parts; ``logs/codes``, the code dictionary; ``logs/shapes``; ``logs/problems``. Archives and
    members that cannot be read are logged and left out.

    An archive has a folder of its own in the panel and counts as read once all it yields is stored. So an
    import that was cut short reads what was not finished, an added archive is read alone, and a
    changed one replaces what it gave before. The logs are put together from the parts of all imports,
    each archive from the last one that read it; the wanted codes belong to the folder and stay the same.
    """
    todo = materialize(new_archives(spark, landing, out), "new-archives")
    if not todo.isEmpty():
        before = _finished(spark, out)
        # an import that was cut short left no mark, so its number and what it wrote are taken over
        number = 0 if before is None else before.agg(F.max("number")).first()[0] + 1
        _import(spark, todo, out, codes, number, before)
        todo.select(*_FILE).write.mode("overwrite").parquet(f"{out}/finished/number={number}")
    last = _finished(spark, out)
    if last is None:
        raise ValueError(f"no archive below {landing}")
    last = checked_broadcast(last.select(F.col("path").alias("archive"), "number"))
    parts = {name: spark.read.parquet(f"{out}/parts/{name}").join(last, ["archive", "number"], "left_semi").drop("number") for name in ("metrics", "shapes", "problems", "descriptions")}
    for name in ("metrics", "shapes", "problems"):
        files.write_csv(parts[name], f"{out}/logs/{name}")
    files.write_csv(reports.first_descriptions(parts["descriptions"]), f"{out}/logs/codes")


def _write_panel(spark: SparkSession, panel: DataFrame, todo: DataFrame, before: DataFrame | None, out: str) -> None:
    """Replace the folders of the archives just read and of no other."""
    keyed = panel.withColumn("archive_key", _key("archive")).hint("rebalance", "archive_key")
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("archive_key").parquet(f"{out}/panel")
    if before is None:
        return
    # archives that broke since they were read before (few) have no rows to replace their old ones with
    stale = todo.join(before, "path", "left_semi").join(panel.select(F.col("archive").alias("path")).distinct(), "path", "left_anti")
    for row in stale.select(_key("path")).toLocalIterator():
        panel.limit(0).write.mode("overwrite").parquet(f"{out}/panel/archive_key={row.archive_key}")


def _import(spark: SparkSession, todo: DataFrame, out: str, codes: Sequence[str], number: int, before: DataFrame | None) -> None:
    members = materialize(archives.list_members(todo), "members")
    scanned = materialize(archives.scan_members(members), "scanned-lines")
    lines, problems = archives.member_lines(scanned), archives.scan_problems(scanned)
    heads = materialize(reports.headers(lines), "report-headers")
    parsed = materialize(reports.rows(lines, heads), "report-rows")
    cells = materialize(reports.melt(parsed), "report-cells")
    columns = materialize(reports.table_columns(heads), "table-columns")
    counts = parsed.groupBy(*reports.MEMBER).agg(F.count(F.lit(1)).alias("rows"))
    merged = reports.merge_tables(cells, reports.merged_names(columns, counts))
    _write_panel(spark, materialize(reports.widen(merged, codes), "panel"), todo, before, out)
    tables = reports.table_metrics(parsed, cells, columns).withColumnRenamed("table", "member")
    found = {
        "metrics": reports.file_metrics(parsed, scanned.filter(F.col("member").isNotNull())).unionByName(tables),
        "shapes": reports.file_shapes(lines, problems),
        "problems": problems,
        "descriptions": reports.descriptions(heads).withColumn("archive", F.col("seen.archive")),
    }
    for name, rows in found.items():
        files.write_parquet(rows, f"{out}/parts/{name}/number={number}")
