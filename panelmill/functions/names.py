"""Column lists, display names and thresholds of the panel data model."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bar columns after the entity key.
PRICE_COLUMNS = ["open", "high", "low", "close", "adj_close"]
BAR_COLUMNS = ["entity", "date", "open", "high", "low", "close", "adj_close", "volume"]

# Entity-level characteristics, in model order.
PRICE_CHARACTERISTICS = [
    "ret_1m", "mom6m", "mom12m", "long_term_return_36m",
    "retvol_1m", "retvol12m", "minret_1m", "rmax5_21d",
    "beta_12m", "betasq_12m", "idiovol_12m",
    "avg_dolvol_1m", "std_dolvol_1m", "avg_log_dolvol_1m",
    "amihud_1m", "zerotrade_1m", "dolvol_growth_1m",
    "price_to_ma12", "dist_from_high_12m", "avg_range_1m",
]
ACCOUNTING_CHARACTERISTICS = [
    "be_me", "ocf_me", "log_comp_market_equity", "op_at", "ocf_at",
    "debt_at", "cash_at", "cashflow_to_debt", "current_ratio", "quick_ratio",
    "capx_at", "capx_growth", "rd_at", "ppe_at", "tangibility", "asset_turnover",
    "sales_to_inventory", "sales_to_cash", "sales_to_receivables",
    "accruals_at", "dividend_dummy", "equity_issuance_at", "repurchase_at",
    "asset_growth", "sales_growth", "ppeinv_gr1a",
    "xrd_missing", "has_compustat_annual",
]
CHARACTERISTICS = PRICE_CHARACTERISTICS + ACCOUNTING_CHARACTERISTICS
BINARY_CHARACTERISTICS = ["dividend_dummy", "xrd_missing", "has_compustat_annual"]
CONTINUOUS_CHARACTERISTICS = [c for c in CHARACTERISTICS if c not in BINARY_CHARACTERISTICS]

# Period-level predictors.
MARKET_COLUMNS = ["market_ret_1m", "market_vol_1m", "vix_avg_1m", "vix_change_1m"]
MACRO_COLUMNS = ["wg_dp", "wg_ep", "wg_bm", "wg_ntis", "wg_tbl", "wg_tms", "wg_dfy", "wg_svar"]

TARGET = "target_excess_return_next_1m"
OLS3_PREDICTORS = ["log_comp_market_equity", "be_me", "mom12m"]

# Models and the names shown in reports.
DISPLAY_NAMES = {
    "historical_mean": "Historical Mean",
    "ols_3": "OLS-3",
    "pls": "PLS",
    "elastic_net": "Elastic Net",
    "random_forest": "Random Forest",
    "gradient_boosting": "Gradient Boosting",
}
BENCHMARK_MODEL = "historical_mean"

# Thresholds.
EXTREME_RETURN_HIGH = 3.0
EXTREME_RETURN_LOW = -0.95
BAD_ROW_SHARE = 0.10
MAX_MISSING_MONTHS = 2
MAX_REPORT_AGE_MONTHS = 12
MAX_CONSTANT_RUN = 12
WINSOR_LOWER, WINSOR_UPPER = 0.01, 0.99
TRAIN_END, VALIDATION_END = "2014-12-31", "2019-12-31"
COEFFICIENT_TOLERANCE = 1e-10
R2_TOLERANCE = 1e-6
CONSTANT_STD = 1e-8
POSITIVE_YEAR_SHARE = 0.5


def predictor_group(
    predictor: Column | str,
    market=MARKET_COLUMNS,
    macro=MACRO_COLUMNS,
    interaction_mark: str = "_x_wg_",
    dummy_prefix: str = "sic2_",
) -> Column:
    """Family of a predictor, from its name."""
    c = F.col(predictor) if isinstance(predictor, str) else predictor
    return (
        F.when(c.isin(*market), "market_vix")
        .when(c.isin(*macro), "welch_goyal")
        .when(c.contains(interaction_mark), "characteristic_macro_interaction")
        .when(c.startswith(dummy_prefix), "sic2")
        .otherwise("stock_characteristic")
    )


def add_display_names(df: DataFrame, model: str = "model", names: dict[str, str] | None = None) -> DataFrame:
    """Readable name next to the model key; unknown models keep their key."""
    pairs = list(chain.from_iterable((DISPLAY_NAMES if names is None else names).items()))
    lookup = F.create_map(*[F.lit(p) for p in pairs])
    return df.withColumn("display_name", F.coalesce(F.try_element_at(lookup, F.col(model)), F.col(model)))
