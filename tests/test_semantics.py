"""Hand-written rows for the rules that are easy to get subtly wrong."""

from __future__ import annotations

import datetime as dt
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators import aggregates, clean, design, joins, linear, metrics, sample, windows
from ledgerline.queries import fixtures


def quarter(i: int) -> dt.date:
    return dt.date(2000 + i // 4, 1 + 3 * (i % 4), 1)


def panel(spark, values, id_="1", start=0, name="x"):
    rows = [(id_, quarter(start + i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"id string, date date, {name} double")


def column(df, name, order="date"):
    return [r[0] for r in df.orderBy("id", order).select(name).collect()]


def test_pct_change_fills_forward_and_never_divides_by_zero(spark):
    got = column(windows.pct_change(panel(spark, [10, None, 12, 0, 5]), ["x"], "id"), "x_qoq")
    assert got[0] is None and got[4] is None
    assert got[1:4] == pytest.approx([0.0, 0.2, -1.0])


def test_gap_of_one_quarter_is_filled(spark):
    filled = windows.gap_fill_single(panel(spark, [5, None, 7]), "x")
    assert column(filled, "x") == [5, 5, 7]
    assert column(filled, "gap_filled") == [False, True, False]


def test_absent_row_is_filled_like_a_null(spark):
    rows = panel(spark, [5, None, 7, 8]).filter("x is not null").withColumn("other", F.lit(1.0))
    filled = windows.gap_fill_single(rows, "x")
    assert column(filled, "x") == [5, 5, 7, 8]
    assert column(filled, "other") == [1, None, 1, 1]
    assert column(filled, "date") == [quarter(i) for i in range(4)]


@pytest.mark.parametrize("drop", [True, False])
def test_gap_of_two_quarters_is_dropped(spark, drop):
    rows = panel(spark, [5, None, None, 7])
    rows = rows.filter("x is not null") if drop else rows
    assert column(windows.gap_fill_single(rows, "x"), "x") == [5, 7]


def test_absent_and_null_neighbours_make_a_long_gap(spark):
    rows = panel(spark, [5, None, None, 7]).filter(F.col("date") != F.lit(quarter(1)))
    assert column(windows.gap_fill_single(rows, "x"), "x") == [5, 7]


def test_ytd(spark):
    assert column(windows.ytd_to_quarterly(panel(spark, [10, 25, 45, 70, 8]), ["x"]), "x") == [10, 15, 20, 25, 8]


def test_ytd_after_a_missing_report_keeps_the_running_value(spark):
    assert column(windows.ytd_to_quarterly(panel(spark, [10, None, 45]), ["x"]), "x") == [10, None, 45]


def test_two_breaks_compound(spark):
    rows = panel(spark, [2, 3, 12, 13, 6.5]).withColumn("b", F.col("date").isin(quarter(2), quarter(4)).cast("double"))
    assert column(windows.back_adjust(rows, "x", "b"), "x") == pytest.approx([4, 6, 6, 6.5, 6.5])


def test_no_break_keeps_a_zero_column(spark):
    flagged = windows.break_flags(panel(spark, [1, 2, 4, 7]), "x", 3.0)
    assert column(flagged, "is_structural_break") == [0.0] * 4


def test_label_stays_inside_its_split(spark):
    rows = design.split_by_date(panel(spark, [1, 2, 3, 4, 5]), str(quarter(2)))
    assert column(windows.lead_target(rows, "x", 1), "label") == [2, 3, None, 5, None]


def test_split_needs_dates_on_both_sides(spark):
    assert design.split_by_date(panel(spark, [1, 2]), str(quarter(1))).count() == 0
    assert design.split_by_date(panel(spark, [1]), 0.2).count() == 0


def test_unseen_level_is_all_zeros(spark):
    rows = spark.createDataFrame([("train", "a"), ("train", "b"), ("test", "c")], "split string, k string")
    hot = design.one_hot(rows, "k", design.train_levels(rows, "k"))
    assert sorted(map(tuple, hot.collect())) == [("test", 0.0, 0.0), ("train", 0.0, 1.0), ("train", 1.0, 0.0)]


def test_a_category_may_have_any_number_of_levels(spark):
    rows = spark.range(1500).select(F.lit("train").alias("split"), F.lpad(F.col("id").cast("string"), 4, "0").alias("k"))
    levels = design.train_levels(rows, "k")
    assert len(levels) == 1500 and levels == sorted(levels)


def test_an_entity_without_a_mean_drops_out_only_above_n(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0)], "id string, v double")
    assert {r.id for r in sample.largest_entities(rows, "v", 5).collect()} == {"a", "b", "c"}
    assert {r.id for r in sample.largest_entities(rows, "v", 2).collect()} == {"a", "c"}


def test_unknown_derivations_are_refused():
    with pytest.raises(ValueError, match="nothing_here"):
        fixtures.with_("panel", "nothing_here")


@pytest.mark.parametrize("module", ["cleaning", "joining", "modelling", "profiling", "sources", "windowing"])
def test_every_query_module_can_be_imported_alone(module):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", f"import ledgerline.queries.{module}"], cwd=root, check=True, timeout=120)


@pytest.mark.parametrize(
    "name,expected",
    [
        ("x 03312023.txt", "Q1 2023"), ("x 20230331.txt", "Q1 2023"), ("x 99999999.txt", "Unknown"), ("x.txt", "Unknown"),
        ("a 19700101 12312024.txt", "Q4 2024"), ("20230230 06302021", "Q2 2021"),
    ],
)
def test_filename_quarter(spark, name, expected):
    assert spark.range(1).select(S.filename_quarter(F.lit(name))).first()[0] == expected


def test_split_part_name(spark):
    row = spark.range(1).select(S.split_part(F.lit("Schedule RCB 03312023(2 OF 3).TXT")).alias("p"), S.split_part(F.lit("x.txt")).alias("q")).first()
    assert row.p.asDict() == {"base": "Schedule RCB 03312023", "part": 2, "total": 3}
    assert row.q is None


def test_numbers_and_days_from_text(spark):
    texts = [" 12.5 ", "-3", "1e3", "12 USD", "", "1d", "NaN", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(S.to_number("t")).collect()] == [12.5, -3.0, 1000.0, None, None, None, None, None]
    rows = spark.createDataFrame([("20230331",), ("20230231",), ("2023-03-31",), (None,)], "t string")
    assert [r[0] for r in rows.select(S.to_day("t")).collect()] == [dt.date(2023, 3, 31), None, None, None]


def test_log_floor(spark):
    rows = spark.createDataFrame([(0.0,), (None,), (-1.0,), (1.0,)], "x double")
    got = [r[0] for r in rows.select(S.log_floor("x")).collect()]
    assert got[0] == got[1] == pytest.approx(-20.7232658) and got[2] is None and got[3] == 0.0


def test_clip_keeps_null(spark):
    rows = spark.createDataFrame([(None,), (5.0,), (-5.0,)], "x double")
    assert [r[0] for r in rows.select(S.clip("x", F.lit(-1.0), F.lit(1.0))).collect()] == [None, 1.0, -1.0]


def test_dedup_ranks_by_the_given_order(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, None)], "k string, o int, v string")
    first = clean.dedup_keep_first(rows, ["k"], [F.col("o")])
    last = clean.dedup_keep_last(rows, ["k"], [F.col("o")])
    assert sorted((r.k, r.v) for r in first.collect()) == [("a", "y"), ("b", None)]
    assert sorted((r.k, r.v) for r in last.collect()) == [("a", "x"), ("b", None)]
    assert first.columns == rows.columns


def test_key_nulls_do_not_become_text(spark):
    rows = spark.createDataFrame([(" 1 ",), (None,), ("  ",)], "id string")
    assert [r[0] for r in clean.standardise_key(rows, "id").collect()] == ["1"]


def test_sum_of_buckets_is_null_if_a_part_is(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in rows.select(S.add_all("a", "b")).collect()] == [3.0, None]


def test_system_total_of_nothing_is_zero(spark):
    assert aggregates.system_totals(panel(spark, [None]), ["x"]).first().x == 0.0


def test_event_names_match_loosely_and_once(spark):
    rows = spark.createDataFrame([("1", quarter(0), "First  Bank"), ("2", quarter(0), "Other")], "id string, date date, bank_name string")
    events = spark.createDataFrame([("FIRST BANK", dt.date(2000, 2, 3)), ("first bank ", dt.date(2000, 3, 3)), ("Gone", dt.date(2000, 1, 1))], "name string, day date")
    order = [F.col("day")]
    joined = joins.event_join(rows, events, "name", "day", order)
    assert sorted((r.id, r.failed) for r in joined.collect()) == [("1", 1.0), ("2", None)]
    assert [r.name for r in joins.unmatched_events(rows, events, "name", "day", order).collect()] == ["Gone"]


def test_broadcast_only_below_the_limit(spark):
    small, big = spark.range(10).toDF("k"), spark.range(100).toDF("k")
    text = lambda df: df._jdf.queryExecution().logical().toString()
    assert "Hint broadcast" in text(joins.checked_broadcast(small, 50))
    assert "Hint broadcast" not in text(joins.checked_broadcast(big, 50))


def test_outliers_are_removed_in_turn(spark):
    values = [(float(i), 1.0) for i in range(20)] + [(1000.0, 1.0), (None, 50.0)]
    rows = spark.createDataFrame([(str(i), a, b) for i, (a, b) in enumerate(values)], "id string, a double, b double")
    left = sample.remove_outliers(rows, ["a", "b", "absent"], 3.0)
    assert {r.id for r in left.collect()} == {str(i) for i in range(20)}


def test_constant_target_keeps_all_rows(spark):
    rows = spark.createDataFrame([("1", 2.0), ("2", 2.0)], "id string, a double")
    assert sample.remove_outliers(rows, ["a"], 3.0).count() == 2


def test_constant_feature_is_only_centred(spark):
    rows = spark.createDataFrame([("train", 0.1), ("train", 0.1), ("train", 0.1), ("test", 0.3)], "split string, x double")
    got = sorted(r[0] for r in design.standard_scale(rows, ["x"]).select("num__x").collect())
    assert got == pytest.approx([0, 0, 0, 0.2])


def test_metrics_edge_cases(spark):
    rows = spark.createDataFrame(
        [("t", 1, "m", "test", 0.0, 1.0), ("t", 1, "m", "test", 2.0, 1.0), ("t", 1, "c", "test", 1.0, 1.0)],
        "target string, horizon int, model string, split string, label double, prediction double",
    )
    got = {r.model: r for r in metrics.regression_metrics(rows).collect()}
    assert (got["m"].mae, got["m"].rmse, got["m"].r2, got["m"].mape) == pytest.approx((1.0, 1.0, 0.0, 50.0))
    assert got["c"].r2 == 1.0 and got["c"].mape == 0.0


def test_ensemble_needs_two_members(spark):
    rows = spark.createDataFrame([("t", 1, "a", "test", "1", quarter(0), 1.0, 2.0)], "target string, horizon int, model string, split string, id string, date date, label double, prediction double")
    assert metrics.voting_ensemble(rows, ["a", "b"]).count() == 0


def test_histogram_puts_the_maximum_in_the_last_bin(spark):
    bins = {r.bin: r.n for r in aggregates.histogram(panel(spark, [0, 1, 2, 3, 4]), "x", 4).collect()}
    assert bins == {0: 1, 1: 1, 2: 1, 3: 2}


def test_expanding_folds(spark):
    folds = [tuple(r) for r in design.expanding_folds(panel(spark, range(10)), 3).orderBy("fold").collect()]
    q = quarter
    assert folds == [(1, q(3), q(4), q(5)), (2, q(5), q(6), q(7)), (3, q(7), q(8), q(9))]


def test_resample_keeps_empty_quarters(spark):
    rows = spark.createDataFrame([(dt.date(2000, 1, 5), None), (dt.date(2000, 1, 7), 3.0), (dt.date(2000, 7, 1), 4.0)], "day date, v double")
    got = [tuple(r) for r in windows.resample_first(rows, "v").orderBy("date").collect()]
    assert got == [(dt.date(2000, 4, 1), 3.0), (dt.date(2000, 7, 1), None), (dt.date(2000, 10, 1), 4.0)] or got == [
        (dt.date(2000, 4, 1), 3.0), (dt.date(2000, 10, 1), 4.0)
    ]


def test_within_transform_centres_entities(spark):
    rows = panel(spark, [1, 3]).unionByName(panel(spark, [10, 20], id_="2"))
    assert column(linear.within_transform(rows, ["x"]), "x") == [-1, 1, -5, 5]
