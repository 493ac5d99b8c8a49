"""Report archives on disk: unpacking, parsing, splitting, merging."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerline.operators.clean import coerce_types
from ledgerline.plans.imports import import_archives
from ledgerline.plans.panel import entity_panel
from ledgerline.sources import archives, files, reports


def write_zip(path, members: dict[str, bytes | str]):
    with zipfile.ZipFile(path, "w") as out:
        for name, content in members.items():
            out.writestr(name, content)


ENT = "IDRSSD\tRCON9999\tRSSD9017\n\tDate\tName\n1\t20230331\tFirst\n2\t20230331\tNA\n"
PART1 = '"IDRSSD"\t"RCON2170"\tRCFD2170\n\t"TOTAL ASSETS"\t123\n1\t100\t900\n 2 \t\t800\n2\t7\t7\n\t5\t5\n3\t\t\n'
PART2 = "IDRSSD\tRCON2200\tRCON2170\r\n\tDeposits\tSecond text\r\n1\t50\t1\r\n4\t60\t2\r\n"


@pytest.fixture(scope="module")
def landing(tmp_path_factory):
    root = tmp_path_factory.mktemp("landing")
    write_zip(
        root / "A 20230331.zip",
        {
            "Schedule ENT 03312023.txt": ENT,
            "Schedule RCB 03312023(1 of 2).txt": PART1,
            "Schedule RCB 03312023(2 of 2).txt": PART2,
            "Schedule RI 03312023(1 of 3).txt": "IDRSSD\tRIAD4107\tRCON2170\n\tIncome\tAgain\n1\t10\t11\n",
            "Readme.doc": "ignored",
            "Schedule X 03312023.txt": "",
            "Schedule L 03312023.txt": "IDRSSD\tTEXT1\tTEXT2\n\tCafé\tTab\n1\tCafé\t\"a\tb \"\"c\"\"\"\n".encode("latin-1"),
            "Schedule Q 03312023.txt": "IDRSSD\tONLY\n\tnothing\n",
            "Schedule N 03312023.txt": "OTHER\tONLY\n\tnothing\n1\t2\n",
        },
    )
    (root / "B 20230630.zip").write_bytes(b"this is not a zip file")
    write_zip(root / "C 20230930.zip", {"Schedule RI 09302023.txt": "IDRSSD\tRIAD4107\tRCON2170\n\tLater text\tX\n1\t25\t12\n9A\t1\t\n"})
    return str(root)


@pytest.fixture(scope="module")
def scanned(spark, landing):
    return archives.read_archives(spark, landing).cache()


@pytest.fixture(scope="module")
def lines(scanned):
    return archives.member_lines(scanned)


def test_problems_are_logged_not_raised(scanned):
    named = archives.scan_problems(scanned).withColumn("archive", archives.base_name("archive"))
    got = sorted((r.archive, r.member, r.problem) for r in named.collect())
    assert got == [("A 20230331.zip", "Schedule X 03312023.txt", "empty file"), ("B 20230630.zip", None, "bad zip file")]


def test_lines_keep_their_place(lines):
    got = lines.filter("member like '%(2 of 2)%'").orderBy("line_no").select("line_no", "line").collect()
    assert [tuple(r) for r in got] == [(0, "IDRSSD\tRCON2200\tRCON2170"), (1, "\tDeposits\tSecond text"), (2, "1\t50\t1"), (3, "4\t60\t2")]


def cells(lines, member):
    got = reports.melt(reports.rows(lines)).filter(F.col("member").startswith(member)).select("id", "code", "value")
    return sorted(tuple(r) for r in got.collect())


def test_rows_are_cleaned(lines):
    # Blank key and all-empty rows go, the first of two copies of key 2 stays.
    assert cells(lines, "Schedule RCB 03312023(1") == [("1", "RCFD2170", "900"), ("1", "RCON2170", "100"), ("2", "RCFD2170", "800")]


def test_latin_text_and_quoted_tabs(lines):
    assert cells(lines, "Schedule L") == [("1", "TEXT1", "Café"), ("1", "TEXT2", 'a\tb "c"')]


def test_member_without_key_or_rows_is_skipped(lines):
    assert cells(lines, "Schedule N") == [] == cells(lines, "Schedule Q")


def test_dictionary_takes_the_first_description(lines):
    got = dict((r.code, r.description) for r in reports.code_dictionary(lines).collect())
    assert got["RCON2170"] == "TOTAL ASSETS" and got["RIAD4107"] == "Income" and got["RCON2200"] == "Deposits"
    assert "RCFD2170" not in got and "IDRSSD" not in got


def test_shapes_and_metrics(lines):
    shapes = {r.member: (r.rows, r.cols) for r in reports.file_shapes(lines).collect()}
    assert shapes["Schedule RCB 03312023(1 of 2).txt"] == (5, 3) and shapes["Schedule Q 03312023.txt"] == (0, 2)
    got = {r.member: r for r in reports.file_metrics(reports.rows(lines)).collect()}
    r = got["Schedule RI 09302023.txt"]
    assert (r.quarter, r.entities, r.non_numeric_ids, r.cells, r.missing, r.missing_pct) == ("Q3 2023", 2, 1, 4, 1, 25.0)


def test_merge(lines):
    merged = reports.read_reports(lines)
    got = {(r.archive.rsplit("/", 1)[-1][0], r.id, r.column): r.value for r in merged.collect()}
    # Part 2 repeats a column of part 1, which therefore loses; entity 4 exists only there.
    assert got[("A", "1", "RCON2170")] == "100" and got[("A", "4", "RCON2200")] == "60" and ("A", "4", "RCON2170") not in got
    # An incomplete group stays on its own and its repeated column gets a suffix.
    assert got[("A", "1", "RCON2170_Schedule RI 03312023_Part_1_of_3")] == "11"
    assert got[("C", "1", "RCON2170")] == "12" and got[("A", "1", "RSSD9017")] == "First"
    assert ("A", "2", "RSSD9017") not in got


def test_most_cells_base_without_preferred_names(spark):
    heads = spark.createDataFrame(
        [("z", "aaa.txt", 0, ["IDRSSD", "X"]), ("z", "bbb.txt", 1, ["IDRSSD", "X", "Y"])], "archive string, member string, member_no int, codes array<string>"
    )
    counts = spark.createDataFrame([("z", "aaa.txt", 3), ("z", "bbb.txt", 2)], "archive string, member string, rows int")
    names = {(r.table, r.code): r.column for r in reports.merged_names(reports.table_columns(heads), counts).collect()}
    assert names == {("aaa", "X"): "X_aaa", ("bbb", "X"): "X", ("bbb", "Y"): "Y"}


def test_from_archives_to_panel(spark, lines):
    wide = reports.widen(reports.read_reports(lines), ["RCON9999", "RSSD9017", "RCON2170", "RCFD2170", "RIAD4107"])
    wide = wide.withColumnRenamed("id", "IDRSSD").withColumn("RCON9999", F.coalesce("RCON9999", F.regexp_extract("archive", r"(\d{8})", 1)))
    panel = entity_panel(wide, [F.col("archive")])
    got = {(r.id, str(r.date)): (r.total_assets, r.interest_income, r.bank_name) for r in panel.collect()}
    assert got[("1", "2023-01-01")] == (100.0, 10.0, "First")
    # The third quarter reports the running year; the first quarter is taken off.
    assert got[("1", "2023-07-01")] == (12.0, 15.0, None)
    assert got[("2", "2023-01-01")][0] == 800.0
    assert not any(i == "9A" for i, _ in got)


def test_evolving_files(spark, tmp_path):
    frames = {
        "a": "select '1' IDRSSD, '20230331' RCON9999, 1L RCON2170", "b": "select '2' IDRSSD, '20230630' RCON9999, 'x' RCON2200, 1 EXTRA",
        "c": "select '3' IDRSSD, 5 RCON2170", "d": "select 1 EXTRA",
    }
    paths = []
    for name, sql in frames.items():
        spark.sql(sql).write.parquet(str(tmp_path / name))
        paths.append(str(tmp_path / name))
    got = files.read_evolving(spark, paths)
    assert sorted(got.columns) == ["IDRSSD", "RCON2170", "RCON2200", "RCON9999"]
    assert sorted(r.IDRSSD for r in got.collect()) == ["1", "2"]
    typed = coerce_types(got, ["IDRSSD"], ["RCON9999"])
    assert dict(typed.dtypes) == {"IDRSSD": "string", "RCON9999": "date", "RCON2170": "double", "RCON2200": "double"}
    with pytest.raises(ValueError):
        files.read_evolving(spark, paths[2:])


def test_equal_names_in_two_folders_are_two_files(spark, tmp_path):
    for folder, value in (("x", 1), ("y", 2)):
        (tmp_path / folder).mkdir()
        write_zip(tmp_path / folder / "Same.zip", {"a/RC.txt": f"IDRSSD\tX\n\tt\n1\t{value}0\n", "b/RC.txt": f"IDRSSD\tY\tZ\n\tt\tt\n1\t{value}1\t{value}2\n"})
    got = reports.melt(reports.rows(archives.member_lines(archives.read_archives(spark, str(tmp_path))))).collect()
    found = sorted((r.archive.split("/")[-2], r.member, r.code, r.value) for r in got)
    assert found == [(f, m, c, v) for f, n in (("x", 1), ("y", 2)) for m, c, v in (("a/RC.txt", "X", f"{n}0"), ("b/RC.txt", "Y", f"{n}1"), ("b/RC.txt", "Z", f"{n}2"))]


def test_damaged_member_is_logged_and_the_rest_read(spark, tmp_path):
    path = tmp_path / "d.zip"
    write_zip(path, {"one.txt": "IDRSSD\tX\n\tt\n1\tfirst\n", "two.txt": "IDRSSD\tX\n\tt\n2\tsecond\n", "three.txt": "IDRSSD\tX\n\tt\n3\tthird\n"})
    path.write_bytes(path.read_bytes().replace(b"2\tsecond", b"2\tsecand"))
    scanned = archives.read_archives(spark, str(tmp_path))
    assert [(r.member, r.problem.split(":")[0]) for r in archives.scan_problems(scanned).collect()] == [("two.txt", "damaged member")]
    assert sorted(r.value for r in reports.melt(reports.rows(archives.member_lines(scanned))).collect()) == ["first", "third"]


def test_quoted_line_breaks_stay_in_their_cell(spark, tmp_path):
    write_zip(tmp_path / "q.zip", {"RC.txt": 'IDRSSD\tX\tY\n\tt\tt\n1\t"two\nlines"\t5\n2\t6" pipe\t7\n3\t"open\t8\n'})
    got = reports.melt(reports.rows(archives.member_lines(archives.read_archives(spark, str(tmp_path))))).collect()
    assert sorted((r.id, r.code, r.value) for r in got)[:4] == [("1", "X", "two\nlines"), ("1", "Y", "5"), ("2", "X", '6" pipe'), ("2", "Y", "7")]


def test_import_job_writes_panel_and_logs(spark, landing, tmp_path):
    import_archives(spark, landing, str(tmp_path), ["RCON2170", "RCON2200", "RIAD4107", "TEXT1"])
    panel = {(r.archive.rsplit("/", 1)[-1][0], r.id): (r.RCON2170, r.RCON2200) for r in spark.read.parquet(f"{tmp_path}/panel").collect()}
    assert panel[("A", "1")] == ("100", "50") and panel[("C", "9A")][1] is None
    read = lambda name: spark.read.option("header", True).option("inferSchema", True).csv(f"{tmp_path}/logs/{name}").collect()
    shapes = {r.member: (r.rows, r.cols) for r in read("shapes")}
    assert shapes["Schedule X 03312023.txt"] == (0, 0) and shapes["Schedule RI 09302023.txt"] == (2, 3)
    metrics = {r.member: r for r in read("metrics")}
    assert metrics["Schedule X 03312023.txt"].entities == 0 and metrics["Schedule Q 03312023.txt"].cells == 0
    both = metrics["Schedule RCB 03312023_Combined_2parts"]
    # Entities 1, 2 and 4; three columns; five known cells.
    assert (both.entities, both.cells, both.missing) == (3, 9, 4)
    assert {r.problem for r in read("problems")} == {"empty file", "bad zip file"}
    assert any(r.code == "RCON2170" for r in read("codes"))


def test_members_of_one_archive_are_read_by_several_tasks(spark, tmp_path):
    members = {f"Schedule {i}.txt": f"IDRSSD\tX\n\tt\n{i}\tvalue\n" for i in range(40)}
    write_zip(tmp_path / "wide one.zip", members)
    (tmp_path / "broken.zip").write_bytes(b"PK nothing")
    listed = archives.list_members(archives.archive_files(spark, str(tmp_path)))
    assert listed.filter("problem is null").count() == 40 and [r.problem for r in listed.filter("problem is not null").collect()] == ["bad zip file"]
    good = listed.filter("problem is null").select("archive", "member_no").repartition(8, "archive", "member_no")
    tasks = good.mapInPandas(archives._streamed, archives.LINE_SCHEMA).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 3
    scanned = archives.read_archives(spark, str(tmp_path))
    assert archives.member_lines(scanned).count() == 120
    # the same lines as from archives that are read whole
    whole = archives.scan_archives(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(str(tmp_path)))
    assert sorted(map(str, scanned.collect())) == sorted(map(str, whole.collect()))


def test_an_archive_beyond_two_gigabytes_is_read_as_a_stream(spark, tmp_path, monkeypatch):
    """Members behind more than 2 GB of others, which no reader of whole files could take."""
    path = tmp_path / "large.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED, allowZip64=True) as out:
        out.writestr("first.txt", "IDRSSD\tX\n\tt\n1\ta\n")
        with out.open(zipfile.ZipInfo("filler.bin"), "w", force_zip64=True) as member:
            block = bytes(1 << 24)
            for _ in range(130):
                member.write(block)
        out.writestr("last.txt", "IDRSSD\tX\n\tt\n2\tb\n")
    assert path.stat().st_size > 2 << 30
    got = reports.melt(reports.rows(archives.member_lines(archives.read_archives(spark, str(tmp_path))))).collect()
    assert sorted((r.member, r.value) for r in got) == [("first.txt", "a"), ("last.txt", "b")]
    path.unlink()


def _reads(monkeypatch):
    """What each import lists, in order."""
    listed, original = [], archives.list_members

    def listing(files_):
        listed.append(sorted(r.path.rsplit("/", 1)[-1] for r in files_.collect()))
        return original(files_)

    monkeypatch.setattr(archives, "list_members", listing)
    return listed


def test_an_added_or_changed_archive_is_read_alone(spark, tmp_path, monkeypatch):
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    landing.mkdir()
    report = "IDRSSD\tX\n\t{text}\n{rows}\n"
    write_zip(landing / "A.zip", {"RC.txt": report.format(text="from A", rows="1\t10")})
    (landing / "B.zip").write_bytes(b"broken")
    listed = _reads(monkeypatch)
    panel = lambda: sorted((r.archive.rsplit("/", 1)[-1], r.id, r.X) for r in spark.read.parquet(f"{out}/panel").collect())
    log = lambda name: sorted(tuple(r) for r in spark.read.option("header", True).csv(f"{out}/logs/{name}").collect())
    import_archives(spark, str(landing), out, ["X"])
    assert panel() == [("A.zip", "1", "10")] and len(log("problems")) == 1
    import_archives(spark, str(landing), out, ["X"])
    write_zip(landing / "C.zip", {"RC.txt": report.format(text="from C", rows="2\t20\n3\t30")})
    import_archives(spark, str(landing), out, ["X"])
    assert panel() == [("A.zip", "1", "10"), ("C.zip", "2", "20"), ("C.zip", "3", "30")]
    assert log("codes") == [("X", "from A")] and len(log("metrics")) == len(log("shapes")) == 2
    write_zip(landing / "A.zip", {"RC.txt": report.format(text="new text", rows="1\t11")})
    write_zip(landing / "B.zip", {"RC.txt": report.format(text="from B", rows="5\t50")})
    import_archives(spark, str(landing), out, ["X"])
    assert panel() == [("A.zip", "1", "11"), ("B.zip", "5", "50"), ("C.zip", "2", "20"), ("C.zip", "3", "30")]
    assert log("problems") == [] and log("codes") == [("X", "new text")]
    (landing / "C.zip").write_bytes(b"broken now")
    import_archives(spark, str(landing), out, ["X"])
    assert panel() == [("A.zip", "1", "11"), ("B.zip", "5", "50")] and len(log("problems")) == 1
    assert listed == [["A.zip", "B.zip"], ["C.zip"], ["A.zip", "B.zip"], ["C.zip"]]


def test_an_import_that_was_cut_short_is_finished(spark, tmp_path, monkeypatch):
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    landing.mkdir()
    write_zip(landing / "A.zip", {"RC.txt": "IDRSSD\tX\n\tt\n1\t10\n"})
    original = reports.file_metrics
    monkeypatch.setattr(reports, "file_metrics", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        import_archives(spark, str(landing), out, ["X"])
    monkeypatch.setattr(reports, "file_metrics", original)
    import_archives(spark, str(landing), out, ["X"])
    assert [(r.id, r.X) for r in spark.read.parquet(f"{out}/panel").collect()] == [("1", "10")]
    assert spark.read.option("header", True).csv(f"{out}/logs/metrics").count() == 1


def test_five_thousand_evolving_files(spark, tmp_path):
    """Footers are read by tasks and grouped by layout: as many scans as layouts, whatever the number of files."""
    import pyarrow as pa
    from pyarrow import parquet

    layouts = [{"IDRSSD": ["1"], "RCON9999": ["20230331"], "RCON2170": [1.0]}, {"IDRSSD": ["2"], "RCON9999": ["20230630"], "EXTRA": [2]}, {"RCON2170": [3.0]}]
    for i in range(5000):
        parquet.write_table(pa.table(layouts[i % 3]), tmp_path / f"{i}.parquet")
    got = files.read_evolving(spark, [str(tmp_path)])
    assert sorted(got.columns) == ["IDRSSD", "RCON2170", "RCON9999"]
    assert {(r.IDRSSD, r.n) for r in got.groupBy("IDRSSD").agg(F.count("*").alias("n")).collect()} == {("1", 1667), ("2", 1667)}
