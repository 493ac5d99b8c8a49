"""Shape of the physical plans: what must not happen at scale."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from ledgerline.queries import catalog, fixtures

QUERIES = catalog.queries()
# Queries that fit models before they return a plan; what they return reads a stored table.
EAGER = {
    "train_matrix", "train_matrix_default", "tree_importance", "run_report", "score_new_panel", "param_search", "param_search_design", "sparse_search", "rfe_select",
    "rfe_select_design", "feature_importance", "selected_features", "feature_count_report", "param_report", "import_job",
}
LAZY = sorted(set(QUERIES) - EAGER)
# Ordering a group of one row per bucket of the whole table: bounded by the bucket count.
BUCKET_WINDOWS = {"split_by_entity"}


def unpartitioned_windows(text: str) -> list[str]:
    """Window nodes without partitioning. A node reads ``Window [functions], [partitioning], [order]``."""
    out = []
    for line in text.splitlines():
        if "Window [" not in line:
            continue
        groups, depth = [""], 0
        for ch in line[line.index("Window [") + len("Window "):]:
            depth += (ch == "[") - (ch == "]")
            groups[-1] += ch
            if ch == "]" and depth == 0:
                groups.append("")
        given = [g for g in groups[1:] if "[" in g]
        if not given or (len(given) == 1 and (" ASC " in given[0] or " DESC " in given[0])):
            out.append(line.strip())
    return out


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_global_window(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in BUCKET_WINDOWS:
        assert unpartitioned_windows(text) == []


def test_unpartitioned_window_is_recognised(spark):
    from pyspark.sql import Window

    rows = spark.range(5).withColumn("g", F.lit(1) + F.col("id") % 2)
    for w, found in ((Window.orderBy("id"), 1), (Window.partitionBy("g").orderBy("id"), 0), (Window.partitionBy("g"), 0), (Window.partitionBy(), 1)):
        assert len(unpartitioned_windows(plan(rows.withColumn("s", F.sum("id").over(w))))) == found


def test_scan_is_pruned_and_filtered(spark, sf_dir):
    text = plan(QUERIES["parquet_scan"](spark, sf_dir))
    schema = re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    assert schema.count(":") == 3 and "GreaterThanOrEqual(o_orderdate" in text


def test_panel_reads_only_what_a_query_uses(spark, sf_dir):
    text = plan(fixtures.panel(spark, sf_dir).select("id", "date", "total_deposits"))
    columns = re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    assert set(re.findall(r"(l_\w+):", columns)) == {"l_suppkey", "l_quantity", "l_shipdate"}


def test_entity_windows_share_one_shuffle(spark, sf_dir):
    from ledgerline.operators import windows

    rows = fixtures.panel(spark, sf_dir).select("id", "date", "npl", "total_assets")
    out = windows.back_adjust(windows.panel_changes(windows.gap_fill_single(rows, "total_assets"), ["npl", "total_assets"]).withColumn("is_structural_break", F.lit(0.0)), "total_assets")
    by_id = re.findall(r"Exchange hashpartitioning\(id#\d+, \d+\)", plan(out))
    assert len(by_id) == 1


def test_several_distinct_counts_repeat_no_row(spark, sf_dir):
    for name in ("split_characteristics", "distinct_entities"):
        assert "Expand" not in plan(QUERIES[name](spark, sf_dir))


def test_no_python_rows_outside_unpacking(spark, sf_dir):
    for name in LAZY:
        if name in ("archive_scan", "ols_cross_products", "fixed_effects_ols"):
            continue
        text = plan(QUERIES[name](spark, sf_dir)) if name in ("tsv_parse", "gap_fill_single", "split_by_entity") else ""
        assert "Python" not in text and "MapInPandas" not in text


def test_every_surveyed_operator_is_registered():
    expected = """archive_scan tsv_parse encoding_fallback code_dictionary filename_quarter split_part_detect split_part_combine schedule_merge
    evolving_parquet_scan parquet_scan csv_scan parquet_sink csv_sink column_name_clean key_standardise drop_all_null_rows drop_any_null_rows
    dedup_keep_first dedup_keep_last null_key_filter numeric_id_filter coerce_numeric coerce_date quarter_start coalesce_dual_code
    rename_by_dictionary prefix_column_select select_present inf_to_null date_range_filter year_filter fill_constant net_flow macro_panel_join
    series_left_chain fuzzy_name_event_join full_outer_fold horizontal_concat entity_semi_join unmatched_anti_join panel_spine metric_lookup
    key_membership_split system_totals date_profile macro_date_mean quantile_band describe_by_variable corr_matrix distinct_entities
    obs_per_entity avg_dates_per_entity entity_threshold_min entity_threshold_mean global_moments global_quantile group_size_by_date
    multi_event_entities all_notnull_entities nulls_by_date pivot_mean pivot_first best_per_group histogram series_diff series_pct_change
    panel_diff panel_pct_change ytd_to_quarterly gap_fill_single ar_lags feature_lags lead_target abs_change_filter break_flag
    break_back_adjust resample_first resample_mean panel_sort top_n_entities sample_entities top_n_importance report_sort head_tail_preview
    union_all_by_name missing_codes_report codes_seen train_test_union file_metrics file_shapes stage_stats missingness_report
    split_characteristics run_coverage ratio_suite quarter_effect zscore_outlier_filter winsorize restrict_sample split_by_date
    split_by_entity standard_scale one_hot horizon_dataset prepare_panel mean_baseline ols fixed_effects_ols ridge lasso elastic_net
    decision_tree random_forest boosted_trees rfe_select expanding_time_folds param_search voting_ensemble batch_score regression_metrics
    train_matrix model_comparison feature_importance feature_count_report param_report""".split()
    assert set(expected) <= set(QUERIES)
