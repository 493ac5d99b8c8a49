"""Parquet and CSV sources with evolving schemas, and sinks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from urllib.parse import quote

import pandas as pd
from pyarrow import fs, parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.codes import ESSENTIAL_CODES, REPORT_CODES


def open_input(path: str):
    """A file that tasks read from any place in it, without fetching it whole."""
    scheme, _, rest = path.partition(":")
    if scheme == "file" or not rest:
        return open("/" + rest.lstrip("/") if rest else path, "rb")
    system, name = fs.FileSystem.from_uri(quote(path, safe=":/@%"))
    return system.open_input_file(name)


def _footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        columns = []
        for path in batch["file"]:
            with open_input(path) as file:
                columns.append(parquet.read_schema(file).names)
        yield pd.DataFrame({"file": batch["file"], "columns": columns})


def schemas(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, columns) of every parquet file at or in the flat folders ``paths``: tasks read the footers."""
    found = spark.read.format("binaryFile").load(list(paths)).select(F.col("path").alias("file"))
    return found.repartition("file").mapInPandas(_footers, "file string, columns array<string>")


def read_evolving(spark: SparkSession, paths: Sequence[str], desired: Iterable[str] = REPORT_CODES, essential: Iterable[str] = ESSENTIAL_CODES) -> DataFrame:
    """Wanted columns of files whose columns differ, stacked by name.

    Files without an essential column, or without any wanted one, are skipped. Files with the same
    wanted columns are read together, so the plan has one pruned scan per layout, not per file. The
    driver is told the layouts and their files' names, which it needs to plan the scans.
    """
    wanted, needed = list(dict.fromkeys(desired)), list(set(essential))
    present = F.filter(F.array(*[F.lit(c) for c in wanted]), lambda c: F.array_contains("columns", c))
    layouts = schemas(spark, paths).select("file", present.alias("present"))
    usable = layouts.filter((F.size("present") > 0) & (F.size(F.array_except(F.array(*[F.lit(c) for c in needed]), "present")) == 0))
    found = usable.groupBy("present").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    if not found:
        raise ValueError("no file has the essential columns")
    frames = [spark.read.parquet(*r.files).select(*[F.col(f"`{c}`") for c in r.present]) for r in sorted(found, key=lambda r: r.files)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def codes_seen(available: DataFrame) -> DataFrame:
    """Distinct codes of a (file, code) table."""
    return available.select("code").distinct()


def missing_codes(available: DataFrame, desired: Sequence[str]) -> DataFrame:
    """(file, code) pairs that are wanted but absent."""
    files = available.select("file").distinct()
    wanted = files.select("file", F.explode(F.array(*[F.lit(c) for c in desired])).alias("code"))
    return wanted.join(available, ["file", "code"], "left_anti")


def read_events(spark: SparkSession, path: str, day: str = "FAILDATE", name: str = "NAME", day_format: str = "yyyy-MM-dd") -> DataFrame:
    """Event list CSV: its day and name columns only."""
    table = spark.read.option("header", True).csv(path)
    return table.select(F.expr(f"try_to_date(`{day}`, '{day_format}')").alias("day"), F.col(name).alias("name"))


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite", codec: str | None = None) -> None:
    # Rows of one output folder meet in few tasks instead of every task writing every folder;
    # the rebalance lets the adaptive planner split a folder that holds most of the rows.
    out = df.hint("rebalance", *partition_by) if partition_by else df
    writer = out.write.mode(mode).partitionBy(*partition_by)
    if codec:
        writer = writer.option("compression", codec)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Logs and code maps as CSV with a header."""
    df.write.mode(mode).option("header", True).csv(path)
