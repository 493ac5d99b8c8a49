"""Zip archives of text members as a table of lines."""

from __future__ import annotations

import codecs
import io
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import materialize
from ledgerline.sources.files import open_input

LINE_SCHEMA = "archive string, member_no int, member string, line_no long, line string, problem string"
SPREAD_LINES = 50_000
_CHUNK_ROWS, _CHUNK_CHARS = 20_000, 8_000_000
_BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError)


def _encoding(archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> str:
    """UTF-8, or Latin-1 for a member that is not valid UTF-8 throughout.

    The member is read to its end either way, so that damage shows before a line of it is handed on.
    """
    decoder, valid = codecs.getincrementaldecoder("utf-8-sig")(), True
    with archive.open(info) as stream:
        while part := stream.read(1 << 20):
            if valid:
                try:
                    decoder.decode(part)
                except UnicodeDecodeError:
                    valid = False
    try:
        decoder.decode(b"", final=True)
    except UnicodeDecodeError:
        valid = False
    return "utf-8-sig" if valid else "latin-1"


def _whole_lines(lines: Iterable[str]) -> Iterator[str]:
    """Lines with quoted line breaks inside; a cell is quoted when a quote is its first character."""
    held: list[str] = []
    for line in lines:
        line = line.rstrip("\n")
        odd = line.count('"') % 2 == 1
        if held:
            held.append(line)
            if odd:
                yield "\n".join(held)
                held = []
        elif odd and (line.startswith('"') or '\t"' in line):
            held = [line]
        else:
            yield line
    yield from held  # a quote that is never closed takes no other line with it


def _flush(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["archive", "member_no", "member", "line_no", "line", "problem"])


def _text_members(archive: zipfile.ZipFile) -> Iterator[tuple[int, str, zipfile.ZipInfo]]:
    """Number, name and entry of every ``.txt`` member; a name that comes twice gets its number."""
    seen: set[str] = set()
    for no, info in enumerate(archive.infolist()):
        member = info.filename
        if info.is_dir() or not member.lower().endswith(".txt"):
            continue
        if member in seen:
            member = f"{member[:-4]} #{no}{member[-4:]}"
        seen.add(member)
        yield no, member, info


def _lines_of(path: str, archive: zipfile.ZipFile, members: Iterable[tuple[int, str, zipfile.ZipInfo]]) -> Iterator[tuple]:
    """Rows of the members' lines, read as a stream; a damaged or an empty member becomes a log row."""
    for no, member, info in members:
        if info.file_size == 0:
            yield (path, no, member, None, None, "empty file")
            continue
        try:
            encoding = _encoding(archive, info)
        except _BROKEN as e:
            yield (path, no, member, None, None, f"damaged member: {e}")
            continue
        with archive.open(info) as stream:
            for line_no, line in enumerate(_whole_lines(io.TextIOWrapper(stream, encoding=encoding))):
                yield (path, no, member, line_no, line, None)


def _in_chunks(rows: Iterable[tuple]) -> Iterator[pd.DataFrame]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[4] or "")
        if len(held) >= _CHUNK_ROWS or chars >= _CHUNK_CHARS:
            yield _flush(held)
            held, chars = [], 0
    if held:
        yield _flush(held)


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of whole archives that were read into memory."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    yield (path, None, None, None, None, "bad zip file")
                    continue
                with archive:
                    yield from _lines_of(path, archive, _text_members(archive))

    yield from _in_chunks(rows())


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members of archives from their directories, at whose end nothing else has been read; bad archives as log rows."""
    for batch in batches:
        rows: list[tuple] = []
        for path in batch["path"]:
            try:
                with open_input(path) as file, zipfile.ZipFile(file) as archive:
                    rows += [(path, no, member, info.file_size, None) for no, member, info in _text_members(archive)]
            except (zipfile.BadZipFile, pa.ArrowInvalid):  # the latter: shorter than any directory
                rows.append((path, None, None, None, "bad zip file"))
        yield pd.DataFrame(rows, columns=["archive", "member_no", "member", "size", "problem"]).astype({"member_no": "Int32", "size": "Int64"})


def _streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of single members, from archives opened by path."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for path, wanted in batch.groupby("archive", sort=False)["member_no"]:
                numbers = set(wanted)
                with open_input(path) as file, zipfile.ZipFile(file) as archive:
                    yield from _lines_of(path, archive, [m for m in _text_members(archive) if m[0] in numbers])

    yield from _in_chunks(rows())


MEMBER_SCHEMA = "archive string, member_no int, member string, size long, problem string"


def list_members(files: DataFrame) -> DataFrame:
    """(archive, member_no, member, size, problem) of the archives in a (path) table, read by tasks from their directories."""
    return files.select("path").repartition("path").mapInPandas(_listed, MEMBER_SCHEMA)


def scan_members(members: DataFrame) -> DataFrame:
    """Lines of the listed members, each read as a stream by whichever task it falls to.

    Members are spread one by one, so one archive keeps many tasks busy and is nowhere held in memory,
    whatever its size. The lines are spread once more in chunks, as parsing a large member costs
    more than unpacking it.
    """
    good = members.filter(F.col("problem").isNull()).select("archive", "member_no").repartition("archive", "member_no")
    lines = good.mapInPandas(_streamed, LINE_SCHEMA).repartition("archive", "member", F.floor(F.col("line_no") / SPREAD_LINES))
    null = F.lit(None)
    problems = members.filter(F.col("problem").isNotNull())
    return lines.unionByName(
        problems.select("archive", null.cast("int").alias("member_no"), null.cast("string").alias("member"), null.cast("long").alias("line_no"), null.cast("string").alias("line"), "problem")
    )


def scan_archives(files: DataFrame) -> DataFrame:
    """Lines of the archives in a (path, content) table, as read by the ``binaryFile`` source (at most 2 GB each).

    For archives that only Spark can reach; :func:`read_archives` opens them by path. ``archive`` is the
    whole path and ``member`` the whole name inside it: equal names in two folders are two files.
    """
    lines = files.select("path", "content").mapInPandas(_unpacked, LINE_SCHEMA)
    return lines.repartition("archive", "member", F.floor(F.col("line_no") / SPREAD_LINES))


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime) of all ``*.zip`` files under ``path``; nothing of them is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    return found.select("path", "length", "modificationTime")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all ``*.zip`` files under ``path``, unpacked member by member."""
    return scan_members(materialize(list_members(archive_files(spark, path)), "members"))


def member_lines(scanned: DataFrame) -> DataFrame:
    return scanned.filter(F.col("problem").isNull()).drop("problem")


def base_name(column: str) -> Column:
    """Name without its folders, for display and for what is written in file names."""
    return F.element_at(F.split(column, "/"), -1)


def scan_problems(scanned: DataFrame) -> DataFrame:
    return scanned.filter(F.col("problem").isNotNull()).select("archive", "member", "problem")
