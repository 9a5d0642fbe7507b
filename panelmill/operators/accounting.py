"""Annual reports: derived measures, growth and merge into a monthly panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.functions.names import MAX_REPORT_AGE_MONTHS
from panelmill.functions.scalars import (
    MISSING_CODES, first_present, month_number, normalize_code, null_out, optional_column, positive, positive_log,
    safe_ratio, shift_month_end, to_date_or_null, to_double, zero_if_null,
)
from panelmill.operators.relational import asof_join, equal_where_present, keep_last
from panelmill.operators.timeline import growth_over_spacing

# Reports that count, numeric report items, and weights of the tangibility measure.
REPORT_FILTERS = {"consol": "C", "indfmt": "INDL", "datafmt": "STD", "popsrc": "D", "curcd": "USD"}
REPORT_ITEMS = [
    "act", "lct", "at", "lt", "ceq", "seq", "teq", "txditc", "txdb", "itcb", "che", "dlc", "dltt", "dt",
    "pstk", "pstkrv", "pstkl", "invt", "rect", "ppegt", "ppent", "csho", "sale", "cogs", "xsga", "xrd",
    "oiadp", "ib", "oancf", "capx", "dvt", "sstk", "prstkc", "mkvalt", "prcc_c", "prcc_f", "sic",
]
TANGIBILITY_WEIGHTS = {"rect": 0.715, "invt": 0.547, "ppegt": 0.535}
GROWTH_SPACING_DAYS = (300, 430)
REPORT_LAG_MONTHS = 6


def standardise_reports(raw: DataFrame, entity: str = "tic", company: str = "gvkey", date: str = "datadate") -> DataFrame:
    """Typed, filtered reports: one row per company and date, absent items as NULL columns."""
    coded = raw.withColumn("entity", normalize_code(entity)).withColumn("company", F.trim(F.col(company).cast("string")))
    dated = coded.withColumn("datadate", to_date_or_null(date))
    valid = dated.filter(F.col("datadate").isNotNull() & F.col("entity").isNotNull() & ~F.col("entity").isin(*MISSING_CODES))
    kept = equal_where_present(valid, REPORT_FILTERS)
    typed = kept.select(
        "entity", "company", "datadate",
        *[to_double(optional_column(kept, c)).alias(c) for c in REPORT_ITEMS],
    )
    return keep_last(typed, ["company", "datadate"], ["entity", *REPORT_ITEMS])


def report_measures(reports: DataFrame) -> DataFrame:
    """Levels, 20 ratios and indicators from one report row. Expects all of ``REPORT_ITEMS``."""
    c = F.col
    preferred = first_present("pstkrv", "pstkl", "pstk", F.lit(0.0))
    deferred = first_present("txditc", zero_if_null("txdb") + zero_if_null("itcb"))
    equity = first_present("seq", c("ceq") + preferred, c("at") - c("lt"), "teq")
    levels = reports.select(
        "*",
        positive(equity + deferred - preferred).alias("book_equity"),
        first_present("mkvalt", F.abs("prcc_f") * c("csho"), F.abs("prcc_c") * c("csho")).alias("market_equity"),
        first_present("dt", zero_if_null("dlc") + zero_if_null("dltt")).alias("debt_total"),
        zero_if_null("xrd").alias("xrd_filled"),
        first_present("oiadp", c("sale") - c("cogs") - zero_if_null("xsga") + zero_if_null("xrd")).alias("operating_profit"),
    )
    weighted: Column = c("che")
    for item, weight in TANGIBILITY_WEIGHTS.items():
        weighted = weighted + F.lit(weight) * c(item)
    # Numerator and denominator of each ratio.
    ratios: dict[str, tuple[Column | str, str]] = {
        "be_me": ("book_equity", "market_equity"),
        "ocf_me": ("oancf", "market_equity"),
        "op_at": ("operating_profit", "at"),
        "ocf_at": ("oancf", "at"),
        "debt_at": ("debt_total", "at"),
        "cash_at": ("che", "at"),
        "cashflow_to_debt": ("oancf", "debt_total"),
        "current_ratio": ("act", "lct"),
        "quick_ratio": (c("act") - c("invt"), "lct"),
        "capx_at": ("capx", "at"),
        "rd_at": ("xrd_filled", "at"),
        "ppe_at": ("ppent", "at"),
        "tangibility": (weighted, "at"),
        "asset_turnover": ("sale", "at"),
        "sales_to_inventory": ("sale", "invt"),
        "sales_to_cash": ("sale", "che"),
        "sales_to_receivables": ("sale", "rect"),
        "accruals_at": (c("ib") - c("oancf"), "at"),
        "equity_issuance_at": ("sstk", "at"),
        "repurchase_at": ("prstkc", "at"),
    }
    return levels.select(
        "*",
        *[safe_ratio(n, d).alias(name) for name, (n, d) in ratios.items()],
        positive_log("market_equity").alias("log_comp_market_equity"),
        (zero_if_null("dvt") > 0).cast("int").alias("dividend_dummy"),
        c("xrd").isNull().cast("int").alias("xrd_missing"),
        F.floor(c("sic") / 100).cast("double").alias("sic2"),
    )


def report_growth(reports: DataFrame, company: str = "company", date: str = "datadate") -> DataFrame:
    """Growth on the previous report of the company, if that is about a year older."""
    c = F.col
    ppeinv = c("ppegt") + c("invt")
    with_sum = reports.withColumn("__ppeinv", ppeinv)
    out = growth_over_spacing(
        with_sum, company, date,
        {
            "asset_growth": (c("at"), c("at"), c("at")),
            "sales_growth": (c("sale"), c("sale"), c("sale")),
            "capx_growth": (c("capx"), c("capx"), c("capx")),
            "ppeinv_gr1a": (c("__ppeinv"), c("__ppeinv"), c("at")),
        },
        *GROWTH_SPACING_DAYS,
    )
    return out.drop("__ppeinv")


def with_availability(reports: DataFrame, date: str = "datadate", months: int = REPORT_LAG_MONTHS) -> DataFrame:
    """``available_month``: the month end from which a report may be used; one report per entity and such month."""
    dated = reports.withColumn("available_month", shift_month_end(date, months))
    return keep_last(dated, ["entity", "available_month"], [date, "company"])


def merge_reports(
    panel: DataFrame, reports: DataFrame, entity: str = "entity", month: str = "month",
    max_age: int = MAX_REPORT_AGE_MONTHS, split: str | None = None,
) -> DataFrame:
    """Latest available report per panel row; older than ``max_age`` months since availability counts as none.

    Adds ``has_compustat_annual`` and ``stale_report``.
    """
    values = [c for c in reports.columns if c != entity]
    joined = asof_join(panel, reports, [entity], month, "available_month", split)
    age = month_number(month) - month_number("available_month")
    stale = F.coalesce(age > max_age, F.lit(False))
    marked = joined.withColumn("stale_report", stale)
    cleared = null_out(marked, F.col("stale_report"), values)
    return cleared.withColumn("has_compustat_annual", F.col("available_month").isNotNull().cast("int"))
