"""From quarterly report tables to the prepared study panel."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ledgerline.config import PanelConfig
from ledgerline.functions import scalars as S
from ledgerline.functions.codes import FLOW_PREFIX, KEY_CODES
from ledgerline.operators import clean, sample, windows
from ledgerline.operators.design import ENTITY, entity_effect, quarter_effect
from ledgerline.operators.joins import checked_broadcast, event_join, macro_panel_join
from ledgerline.session import materialize

# Ratio name -> (numerator, denominator).
RATIOS = {
    "deposit_ratio": ("total_deposits", "total_assets"),
    "loan_to_deposit_ratio": ("total_loans_and_leases", "total_deposits"),
    "loan_to_asset_ratio": ("total_loans_and_leases", "total_assets"),
    "equity_to_asset_ratio": ("total_equity", "total_assets"),
    "trading_assets_ratio": ("trading_assets", "total_assets"),
    "roe": ("net_income", "total_equity"),
    "roa": ("net_income", "total_assets"),
    "net_charge_offs_to_loans_and_leases": ("net_charge_offs", "total_loans_and_leases"),
    "npl_ratio": ("npl", "total_loans_and_leases"),
    "charge_off_ratio": ("total_charge_offs", "total_loans_and_leases"),
    "rwa_ratio": ("total_rwa", "total_assets"),
}
# Maturity buckets of deposits and of loans.
DEPOSIT_BUCKETS = [
    "dep_small_3m_less", "dep_small_3m_1y", "dep_small_1y_3y", "dep_small_3y_more",
    "dep_large_3m_less", "dep_large_3m_1y", "dep_large_1y_3y", "dep_large_3y_more",
]
LOAN_BUCKETS = [
    "closed_end_first_liens_1_4_res_prop_3m_less", "closed_end_first_liens_1_4_res_prop_3m_1y", "closed_end_first_liens_1_4_res_prop_1y_3y",
    "closed_end_first_liens_1_4_res_prop_3y_5y", "closed_end_first_liens_1_4_res_prop_5y_15y", "closed_end_first_liens_1_4_res_prop_15y_more",
    "all_other_loans_3m_less", "all_other_loans_3m_1y", "all_other_loans_1y_3y", "all_other_loans_3y_5y", "all_other_loans_5y_15y", "all_other_loans_15y_more",
]
TO_ASSETS = [
    "net_income", "net_interest_income", "interest_income", "interest_expense", "non_interest_income",
    "non_interest_expense", "allowance_for_loan_and_lease_losses", "allowance_for_credit_losses",
    "provisions_for_credit_losses", *DEPOSIT_BUCKETS, *LOAN_BUCKETS, "dep_demand", "dep_transaction_accounts",
]


# Which buckets are short and which long term.
TERMS = {
    "dep_short_term": ["dep_small_3m_less", "dep_small_3m_1y", "dep_large_3m_less", "dep_large_3m_1y"],
    "dep_long_term": ["dep_small_1y_3y", "dep_small_3y_more", "dep_large_1y_3y", "dep_large_3y_more"],
    "loans_short_term": [
        "closed_end_first_liens_1_4_res_prop_3m_less", "closed_end_first_liens_1_4_res_prop_3m_1y", "all_other_loans_3m_less", "all_other_loans_3m_1y",
    ],
    "loans_long_term": [
        "closed_end_first_liens_1_4_res_prop_1y_3y", "closed_end_first_liens_1_4_res_prop_3y_5y", "closed_end_first_liens_1_4_res_prop_5y_15y",
        "closed_end_first_liens_1_4_res_prop_15y_more", "all_other_loans_1y_3y", "all_other_loans_3y_5y", "all_other_loans_5y_15y", "all_other_loans_15y_more",
    ],
}


def ratio_columns(available: Sequence[str]) -> dict[str, Column]:
    """Ratio expressions that the available columns allow."""
    have = set(available)
    out: dict[str, Column] = {}
    for name, (num, den) in RATIOS.items():
        if {num, den} <= have:
            out[name] = S.ratio(num, den)
    for c in TO_ASSETS:
        if {c, "total_assets"} <= have:
            out[f"{c}_to_assets"] = S.ratio(c, "total_assets")
    if {"interest_income", "interest_expense", "total_assets"} <= have:
        out["net_interest_margin"] = S.ratio(F.col("interest_income") - F.col("interest_expense"), "total_assets")
    for name, parts in TERMS.items():
        if set(parts) <= have:
            out[name] = S.add_all(*parts)
            if "short" in name and "total_assets" in have:
                out[f"{name}_to_assets"] = S.ratio(S.add_all(*parts), "total_assets")
    if "total_assets" in have:
        out["log_total_assets"] = S.log_floor("total_assets")
    return out


def ratio_suite(df: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """Append all ratios the columns allow, or just the named ones."""
    made = ratio_columns(df.columns)
    return df.withColumns({n: c for n, c in made.items() if only is None or n in only})


def entity_panel(reports: DataFrame, order: list[Column], events: DataFrame | None = None, event_order: list[Column] | None = None) -> DataFrame:
    """Typed entity x quarter panel from stacked wide reports with raw codes.

    ``order`` ranks copies of an (id, quarter); the first stays. It may use any report column.
    """
    keyed = reports.withColumns({f"_o{i}": c for i, c in enumerate(order)})
    ranks = [f"_o{i}" for i in range(len(order))]
    typed = clean.coerce_types(keyed, [c for c in (*KEY_CODES, *ranks) if c != "RCON9999"], ["RCON9999"])
    named = clean.rename_codes(clean.coalesce_dual_codes(typed))
    numeric = clean.numeric_ids(named).filter(F.col("date").isNotNull())
    dated = numeric.withColumn("date", S.quarter_start("date"))
    unique = clean.dedup_keep_first(dated, ["id", "date"], [F.col(r) for r in ranks]).drop(*ranks)
    raw_flows = clean.columns_with_prefix(reports, FLOW_PREFIX)
    flows = [n for c, n in zip(raw_flows, clean.rename_codes(reports.select(*raw_flows)).columns)]
    quarterly = windows.ytd_to_quarterly(unique, flows)
    if events is not None:
        quarterly = event_join(quarterly, events, "name", "day", event_order or [F.col("day"), F.col("name")])
    if {"total_charge_offs", "total_recoveries"} <= set(quarterly.columns):
        quarterly = clean.net_flow(quarterly)
    return quarterly


@dataclass(frozen=True)
class PreparedPanel:
    data: DataFrame
    numeric: list[str]
    categorical: list[str]
    absent: list[str]
    stages: DataFrame
    fills: DataFrame


def stage_row(df: DataFrame, stage: str) -> DataFrame:
    """Rows, entities and dates of one step."""
    return df.agg(
        F.lit(stage).alias("stage"), F.count("*").alias("rows"), F.count_distinct("id").alias("entities"),
        F.min("date").alias("min_date"), F.max("date").alias("max_date"),
    )


def stage_stats(stages: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [stage_row(df, name) for name, df in stages.items()])


def _stored_features(selected: DataFrame, counted: str, least: int) -> tuple[DataFrame, DataFrame]:
    """The stored rows, with the entity's number of known values in ``_known``, and the rows of their two stages.

    The count shares the exchange of the entity windows before it. What the stage rows tell is observed
    while the table is written, so the rows are not read again for it.
    """
    entity = Window.partitionBy("id")
    marked = selected.withColumn("_known", F.count(counted).over(entity)).withColumn("_first", F.row_number().over(windows.by_entity()) == 1)
    kept = (F.col("_known") >= least) | F.lit(least <= 1)
    seen, metrics = Observation(), []
    for stage, there in (("features", F.lit(True)), ("min_observations", kept)):
        metrics += [
            F.count_if(there).alias(f"{stage}_rows"), F.count_if(there & F.col("_first")).alias(f"{stage}_entities"),
            F.min(F.when(there, F.col("date"))).alias(f"{stage}_min_date"), F.max(F.when(there, F.col("date"))).alias(f"{stage}_max_date"),
        ]
    base = materialize(marked.observe(seen, *metrics).drop("_first"), "panel-features")
    names = ("rows", "entities", "min_date", "max_date")
    rows = [(stage, *[seen.get[f"{stage}_{n}"] for n in names]) for stage in ("features", "min_observations")]
    date = selected.schema["date"].dataType.simpleString()
    return base, base.sparkSession.createDataFrame(rows, f"stage string, rows long, entities long, min_date {date}, max_date {date}")


def prepare_panel(panel: DataFrame, macro: DataFrame, index: DataFrame | None, cfg: PanelConfig) -> PreparedPanel:
    """Gap fill, ratios, changes, macro join, sample rules, break correction and winsorising.

    ``panel`` has one row per (id, date). All entity windows share one shuffle on ``id``. The steps
    whose successors need statistics of the whole sample are written once; the passes that take
    the statistics then read only their own columns.
    """
    on_dates = panel.filter(F.col("id").isNotNull() & F.col("date").isNotNull())
    on_dates = on_dates.join(checked_broadcast(macro.select("date").distinct()), "date", "left_semi")
    filled = windows.gap_fill_single(on_dates, "total_assets")
    ratios = ratio_suite(filled, {*cfg.features, *cfg.targets, "log_total_assets", "deposit_ratio"})
    featured = windows.panel_changes(ratios, cfg.entity_variables)
    joined = macro_panel_join(featured, macro, index)

    features = cfg.base_features
    if cfg.include_engineered_features:
        made = [f"{c}{s}" for c in cfg.entity_variables for s in ("_diff", "_qoq") if c in joined.columns]
        features = list(dict.fromkeys([*features, *made]))
    extra = ["total_assets"] if cfg.min_mean_size is not None else []
    counted = next(c for c in ("total_assets", "log_total_assets", "deposit_ratio") if c in [*features, *cfg.targets, *extra, "log_total_assets"])
    wanted = [*features, *cfg.targets, *extra, counted]
    selected, absent = clean.select_present(joined, ["id", "date", *wanted, "gap_filled"])
    absent = [c for c in absent if c != "is_structural_break"]
    base, counted_stages = _stored_features(selected, counted, cfg.min_obs_per_entity)

    # The rule's count is stored with each row: a filter for the scan, not a window for each pass below.
    enough = base.filter(F.col("_known") >= cfg.min_obs_per_entity) if cfg.min_obs_per_entity > 1 else base
    enough, base = enough.drop("_known"), base.drop("_known")
    without_outliers = sample.remove_outliers(enough, cfg.targets, cfg.outlier_threshold)
    # Break and winsorising limits are statistics of the restricted sample, so it is kept as well.
    restricted = materialize(sample.restrict_sample(without_outliers, cfg), "panel-sample")
    final = restricted
    if cfg.correct_breaks and "log_total_assets" in final.columns:
        final = windows.back_adjust(windows.break_flags(final, "log_total_assets", cfg.break_std_threshold), "log_total_assets")
    if cfg.winsorize:
        final = materialize(final, "panel-adjusted")
        final = sample.winsorize(final, cfg.winsorize, cfg.winsorize_lower, cfg.winsorize_upper)
    effects = {}
    if cfg.include_quarter_effect:
        effects["quarter"] = quarter_effect()
    if cfg.include_entity_effect:
        effects[ENTITY] = entity_effect()
    final = final.withColumns(effects) if effects else final
    stages = counted_stages.unionByName(stage_stats({"outliers": without_outliers, "restricted": restricted}))
    numeric = [f for f in features if f in final.columns]
    return PreparedPanel(
        final.drop("gap_filled"), numeric, list(effects), absent, stages, windows.fill_summary(base)
    )


def merge_tables(panel: DataFrame, macro: DataFrame, index: DataFrame | None) -> DataFrame:
    """The three-way merge: macro quarters, panel rows, index levels."""
    return macro_panel_join(panel, macro, index)
