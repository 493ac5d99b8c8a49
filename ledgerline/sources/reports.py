"""Tab-separated reports: header, dictionary, cells, split members, merge of an archive's tables.

Files of one archive have different columns, so they are handled as long cells
(archive, member, id, code, value) and become wide once, at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.functions.codes import BASE_TABLE_NAMES
from ledgerline.session import materialize
from ledgerline.sources.archives import base_name

KEY = "IDRSSD"
MEMBER = ["archive", "member"]
# A cell is either a quoted text, which may contain tabs, or everything up to the next tab.
_CELL = r'\t("(?:[^"]|"")*"(?=\t|$)|[^\t]*)'


def cells(line: Column) -> Column:
    """Cells of a line; only lines with a quote need the slower pattern."""
    quoted = F.regexp_extract_all(F.concat(F.lit("\t"), line), F.lit(_CELL), 1)
    return F.when(line.contains('"'), quoted).otherwise(F.split(line, "\t", -1))


def headers(lines: DataFrame) -> DataFrame:
    """One row per member: codes (line 0) and descriptions (line 1), by position."""
    top = lines.filter(F.col("line_no") < 2).withColumn("_cells", cells(F.col("line")))
    pick = lambda n: F.max(F.when(F.col("line_no") == n, F.col("_cells")))
    return top.groupBy(*MEMBER).agg(
        F.transform(pick(0), S.unquote).alias("codes"),
        pick(1).alias("descriptions"),
        F.min("member_no").alias("member_no"),
    )


def descriptions(heads: DataFrame) -> DataFrame:
    """(code, description) of every member that describes a code usably, with the place where it stands."""
    pairs = heads.select("archive", "member_no", F.posexplode(F.arrays_zip("codes", "descriptions")).alias("pos", "pair"))
    named = pairs.select(
        F.col("pair.codes").alias("code"),
        S.unquote(S.cell_value("pair.descriptions")).alias("description"),
        F.struct("archive", "member_no", "pos").alias("seen"),
    )
    return named.filter((F.length("code") > 0) & (F.col("code") != KEY) & F.col("description").isNotNull() & ~S.is_digits("description"))


def first_descriptions(found: DataFrame) -> DataFrame:
    """code -> description; the first file that describes a code wins."""
    return found.groupBy("code").agg(F.min_by("description", "seen").alias("description"))


def code_dictionary(lines: DataFrame) -> DataFrame:
    """code -> description of all members of ``lines``."""
    return first_descriptions(descriptions(headers(lines)))


def rows(lines: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Cleaned data rows of every member: id, codes and values as arrays.

    Rows without a key or without any value are dropped, and of rows with the same key the
    first stays. Members without a key column yield nothing.
    """
    heads = headers(lines) if heads is None else heads
    at = heads.select(*MEMBER, F.array_position("codes", KEY).cast("int").alias("_at")).filter(F.col("_at") > 0)
    data = lines.filter((F.col("line_no") >= 2) & (F.length("line") > 0)).join(at, MEMBER)
    parsed = data.select(
        *MEMBER, "member_no", "line_no", "_at", F.transform(cells(F.col("line")), S.cell_value).alias("values")
    )
    keyed = parsed.withColumn("id", F.trim(F.get("values", F.col("_at") - 1)))
    others = F.filter("values", lambda v, i: v.isNotNull() & (i != F.col("_at") - 1))
    kept = keyed.filter((F.length("id") > 0) & (F.size(others) > 0))
    first = kept.groupBy(*MEMBER, "member_no", "id").agg(F.min_by("values", "line_no").alias("values"))
    # The codes of a member join last: they are as long as a row and must not travel with every row.
    return first.join(heads.select(*MEMBER, "codes"), MEMBER)


def melt(parsed: DataFrame) -> DataFrame:
    """Long cells (archive, member, member_no, id, code, value); missing values have no cell."""
    pairs = F.filter(F.arrays_zip("codes", "values"), lambda p: p["values"].isNotNull() & (p["codes"] != KEY))
    return parsed.select(*MEMBER, "member_no", "id", F.inline(pairs)).select(
        *MEMBER, "member_no", "id", F.col("codes").alias("code"), F.col("values").alias("value")
    )


def file_shapes(lines: DataFrame, problems: DataFrame | None = None) -> DataFrame:
    """Raw rows and columns per member; with ``problems`` (of the scan) empty and damaged members count 0 x 0."""
    heads = headers(lines).select(*MEMBER, F.size("codes").alias("cols"))
    counts = lines.groupBy(*MEMBER).agg(F.count(F.when((F.col("line_no") >= 2) & (F.length("line") > 0), 1)).alias("rows"))
    shapes = counts.join(heads, MEMBER).select(*MEMBER, "rows", "cols")
    if problems is None:
        return shapes
    unread = problems.filter(F.col("member").isNotNull()).select(*MEMBER, F.lit(0).cast("bigint").alias("rows"), F.lit(0).alias("cols"))
    return shapes.unionByName(unread)


def _metrics(sums: DataFrame, name: str) -> DataFrame:
    return sums.select(
        "archive", name, S.filename_quarter(base_name(name)).alias("quarter"), "entities", "non_numeric_ids", "cells", "missing",
        F.when(F.col("cells") > 0, F.round(F.col("missing") / F.col("cells") * 100, 1)).otherwise(0.0).alias("missing_pct"),
    )


def file_metrics(parsed: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Per member: quarter, entities, non-numeric ids, cells, missing cells and their share.

    With ``members`` (archive, member) those without a usable row have a row of zeros.
    """
    filled = F.size(F.filter("values", lambda v: v.isNotNull())) - 1
    width = F.size("codes") - 1
    sums = parsed.groupBy(*MEMBER).agg(
        F.count("*").alias("entities"),
        F.sum((~S.is_digits(F.trim("id"))).cast("int")).alias("non_numeric_ids"),
        F.sum(width).alias("cells"),
        F.sum(width - filled).alias("missing"),
    )
    if members is not None:
        sums = members.select(*MEMBER).distinct().join(sums, MEMBER, "left").na.fill(0)
    return _metrics(sums, "member")


def table_metrics(parsed: DataFrame, cells_: DataFrame, columns: DataFrame) -> DataFrame:
    """The same per table that was put together from split members.

    ``cells_`` are the melted cells, ``columns`` the result of :func:`table_columns`; an entity counts once,
    whichever parts it is in.
    """
    whole = columns.filter("complete")
    width = whole.groupBy("archive", "table").agg(F.count("*").alias("width"))
    parts = whole.select("archive", "table", "member").distinct()
    entities = parsed.join(parts, MEMBER).select("archive", "table", "id").distinct().groupBy("archive", "table").agg(
        F.count("*").alias("entities"), F.sum((~S.is_digits(F.trim("id"))).cast("int")).alias("non_numeric_ids")
    )
    known = combine_parts(cells_, whole).groupBy("archive", "table").agg(F.count("*").alias("known"))
    sums = entities.join(width, ["archive", "table"]).join(known, ["archive", "table"], "left").na.fill(0, ["known"])
    cells = F.col("entities") * F.col("width")
    return _metrics(sums.withColumn("cells", cells).withColumn("missing", cells - F.col("known")), "table")


def split_groups(members: DataFrame) -> DataFrame:
    """Table every member belongs to: complete split groups share one, other parts stand alone.

    ``members`` has a row per member, as :func:`headers` returns.
    """
    part = members.select(*MEMBER, "member_no", S.split_part("member").alias("_p"))
    groups = part.filter(F.col("_p").isNotNull()).select(*MEMBER, "member_no", "_p.*")
    # Of two members that claim the same part, the later one counts.
    last = groups.groupBy("archive", "base", "total", "part").agg(
        F.max_by(F.struct("member", "member_no"), "member_no").alias("m")
    )
    per_group = last.groupBy("archive", "base", "total").agg(
        F.collect_list(F.struct("part", "m")).alias("parts"),
        (F.count_if(F.col("part").between(1, F.col("total"))) == F.col("total")).alias("complete"),
    )
    named = per_group.select("archive", "base", "total", "complete", F.inline("parts")).select(
        "archive", "m.member", "m.member_no",
        F.when(F.col("complete"), F.concat("base", F.lit("_Combined_"), "total", F.lit("parts")))
        .otherwise(F.concat("base", F.lit("_Part_"), "part", F.lit("_of_"), "total"))
        .alias("table"),
        "part", "complete", F.lit(True).alias("late"),
    )
    whole = part.filter(F.col("_p").isNull()).select(
        *MEMBER, "member_no", F.regexp_replace("member", r"(?i)\.txt$", "").alias("table"),
        F.lit(1).alias("part"), F.lit(False).alias("complete"), F.lit(False).alias("late"),
    )
    return named.unionByName(whole)


def table_columns(members: DataFrame) -> DataFrame:
    """(archive, table, code) with the member that supplies it.

    A column that several parts of a combined table have is taken from the first of them. The
    result is as small as the headers; no data row is needed to know it.
    """
    codes = members.select(*MEMBER, F.explode("codes").alias("code")).filter((F.col("code") != KEY) & (F.length("code") > 0))
    tagged = codes.join(split_groups(members), MEMBER)
    owner = F.min(F.struct("part", "member_no", "member", "complete", "late")).alias("o")
    return tagged.groupBy("archive", "table", "code").agg(owner).select(
        "archive", "table", "code", "o.member", "o.member_no", "o.complete", "o.late"
    )


def combine_parts(cells_: DataFrame, columns: DataFrame) -> DataFrame:
    """Cells by table, from the member that supplies each column."""
    owned = columns.select(*MEMBER, "code", "table")
    return cells_.join(owned, [*MEMBER, "code"]).select("archive", "table", "id", "code", "value")


def _preference(table: Column) -> Column:
    rank = F.lit(len(BASE_TABLE_NAMES) + 1)
    table = F.element_at(F.split(table, "/"), -1)
    for i in reversed(range(len(BASE_TABLE_NAMES))):
        name = BASE_TABLE_NAMES[i]
        named = table.startswith(name) | table.contains(f" {name}") | table.contains(f"_{name}")
        rank = F.when(named, F.lit(i + 1)).otherwise(rank)
    return rank


def merged_names(columns: DataFrame, row_counts: DataFrame | None = None) -> DataFrame:
    """``column``, the name of every (archive, table, code) after the merge.

    The base table (a combined one, else a preferred name, else the one with most cells) comes
    first, then the others in archive order with split members last; a code an earlier table
    already has gets the table name as suffix. ``row_counts`` (archive, member, rows) is only
    needed where no table has a preferred name.
    """
    if row_counts is not None:
        sized = columns.join(row_counts.select(*MEMBER, F.col("rows").alias("_rows")), MEMBER, "left")
    else:
        sized = columns.withColumn("_rows", F.lit(0))
    per_table = Window.partitionBy("archive", "table")
    score = F.when(F.col("complete"), F.lit(0)).otherwise(_preference(F.col("table")))
    sized = sized.withColumns(
        {"_no": F.min("member_no").over(per_table), "_cells": F.sum(F.coalesce("_rows", F.lit(0))).over(per_table), "_score": score}
    )
    by_size = F.when(F.col("_score") > len(BASE_TABLE_NAMES), -F.col("_cells")).otherwise(F.lit(0))
    place = F.struct("_score", by_size.alias("_size"), "late", "_no", "table")
    based = sized.withColumn("_base", F.min(place).over(Window.partitionBy("archive"))["table"])
    order = Window.partitionBy("archive", "code").orderBy((F.col("table") != F.col("_base")).cast("int"), "late", "_no", "table")
    return based.withColumn("_rank", F.row_number().over(order)).select(
        *MEMBER, "table", "code",
        F.when(F.col("_rank") == 1, F.col("code")).otherwise(F.concat("code", F.lit("_"), "table")).alias("column"),
    )


def merge_tables(cells_: DataFrame, names: DataFrame) -> DataFrame:
    """Cells (archive, id, column, value) of the full outer join of an archive's tables."""
    return cells_.join(names.select(*MEMBER, "code", "column"), [*MEMBER, "code"]).select("archive", "id", "column", "value")


def widen(merged: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per (archive, id) with the wanted columns: a single shuffle in place of N outer joins."""
    return merged.groupBy("archive", "id").agg(
        *[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns]
    )


def read_reports(lines: DataFrame) -> DataFrame:
    """Merged cells of all archives from their lines.

    Headers and cells are written once each: the headers are small and used throughout, and the
    cells must not be parsed again for every table that reads them.
    """
    heads = materialize(headers(lines), "report-headers")
    parsed = rows(lines, heads)
    long = materialize(melt(parsed), "report-cells")
    counts = long.groupBy(*MEMBER).agg(F.count_distinct("id").alias("rows"))
    return merge_tables(long, merged_names(table_columns(heads), counts))
