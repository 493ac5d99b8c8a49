"""Settings of a panel preparation run."""

from __future__ import annotations

from dataclasses import dataclass, field

# The default study design (target and feature variables and their level).
DEFAULT_TARGETS = (
    "interest_income_to_assets",
    "interest_expense_to_assets",
    "non_interest_income_to_assets",
    "non_interest_expense_to_assets",
    "net_charge_offs_to_loans_and_leases",
)
DEFAULT_FEATURES = {
    "deposit_ratio": "bank",
    "loan_to_asset_ratio": "bank",
    "dep_demand_to_assets": "bank",
    "log_total_assets": "bank",
    "cpi_qoq": "macro",
    "gdp_qoq": "macro",
    "unemployment_diff": "macro",
    "household_delinq_diff": "macro",
    "tbill_3m_diff": "macro",
    "tbill_10y_diff": "macro",
    "sp500_qoq": "macro",
    "corp_bond_spread_diff": "macro",
    "vix_qoq": "macro",
    "is_structural_break": "bank",
}


@dataclass(frozen=True)
class PanelConfig:
    targets: tuple[str, ...] = DEFAULT_TARGETS
    features: dict[str, str] = field(default_factory=lambda: dict(DEFAULT_FEATURES))
    include_quarter_effect: bool = True
    include_entity_effect: bool = False
    include_engineered_features: bool = True
    outlier_threshold: float = 3.0
    min_obs_per_entity: int = 12
    correct_breaks: bool = True
    break_std_threshold: float = 3.0
    data_begin: str | None = None
    data_end: str | None = None
    max_ratio_change: float | None = None
    min_mean_size: float | None = None
    min_ratio: float | None = None
    largest_entities: int | None = 200
    sample_entities: int | None = None
    winsorize: tuple[str, ...] = ()
    winsorize_lower: float = 0.01
    winsorize_upper: float = 0.99
    include_lags: bool = True
    lags: int = 4
    split_dimension: str = "date"
    test_split: float | str = 0.2
    seed: int = 42

    def __post_init__(self) -> None:
        if self.split_dimension not in ("date", "id"):
            raise ValueError("split_dimension must be 'date' or 'id'")
        for name in ("largest_entities", "sample_entities"):
            value = getattr(self, name)
            if value is not None and value <= 0:
                raise ValueError(f"{name} must be positive")

    @property
    def base_features(self) -> list[str]:
        return [f for f in self.features if f not in self.targets]

    @property
    def entity_variables(self) -> list[str]:
        """Variables that vary by entity: they get the difference and growth columns."""
        names = [f for f, level in self.features.items() if level == "bank"]
        return list(dict.fromkeys([*names, *self.targets, "total_assets"]))
