"""The whole path from daily bars and reports to the model dataset, as plain functions.

Two shuffles carry the panel: one by entity for everything along a history, one exchange of
period summaries for everything across entities. Stages hand over lazy DataFrames and are stored
once, where the grain changes and several readers follow (see ``cut_lineage``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.functions import names
from panelmill.operators import accounting, clean, crosssection, islands, quality, resample, timeline
from panelmill.operators.relational import drop_first_period, join_lagged_period, select_contract, union_all
from panelmill.session import cut_lineage


def clean_daily(raw: DataFrame, order: Sequence[str], **limits) -> tuple[DataFrame, DataFrame]:
    """(clean bars, entity report) from raw bars; ``order`` ranks copies of a day."""
    one = clean.drop_repeats(raw, "entity", "date", order)
    flagged = clean.flag_bars(one, "entity", "date", **{k: v for k, v in limits.items() if k in ("high_return", "low_return")})
    flagged = cut_lineage(flagged)  # read by the report and by the filter
    report = clean.quality_report(flagged, "entity", "date", limits.get("bad_share", names.BAD_ROW_SHARE))
    return clean.clean_bars(flagged, report, "entity", names.BAR_COLUMNS), report


def monthly_panel(
    bars: DataFrame, market: DataFrame, level: DataFrame, rates: DataFrame,
    max_missing: int = names.MAX_MISSING_MONTHS, first: str | None = None, last: str | None = None,
    beta_rows: int = 252, beta_min: int = 126, block_rows: int | None = None, is_stored: bool = False,
) -> DataFrame:
    """Monthly entity panel with price, risk, liquidity and market predictors and the next-month target.

    ``bars``: (entity, date, OHLC, adj_close, volume); ``market``: (date, adj_close); ``level``: (date, level);
    ``rates``: (month, rate). Bars (unless ``is_stored``) and the monthly table are stored once, as several steps read them.
    ``block_rows`` cuts long daily histories for the rolling risk measures.
    """
    bars = bars if is_stored else cut_lineage(bars)
    monthly = resample.resample_monthly(bars, "entity", "date")
    with_ret = cut_lineage(timeline.gap_aware_return(monthly, "entity", "month", "last_adj_close", "ret_1m").drop("ret_1m_gap"))
    returns = resample.daily_returns(bars, "entity", "date")
    kept, kept_returns = timeline.remove_fragmented(with_ret, [returns], "entity", "month", max_missing)
    trends = timeline.price_trends(kept, "entity", "month")
    with_market = resample.add_period_features(
        trends, resample.market_monthly(market, "date", "adj_close"), resample.level_monthly(level, "date", "level")
    )
    market_ret = resample.series_returns(market, "date", "adj_close", "market_ret").select("date", "market_ret")
    risk = resample.monthly_risk(kept_returns, market_ret, "entity", "date", beta_rows, beta_min, block_rows)
    with_risk = with_market.join(risk, ["entity", "month"], "left")
    out = timeline.next_period_target(with_risk, "entity", "month", "ret_1m", rates, "rate", names.TARGET)
    out = out.drop(f"{names.TARGET}_gap").filter(F.col(names.TARGET).isNotNull())
    if first:
        out = out.filter(F.col("month") >= F.lit(first).cast("date"))
    if last:
        out = out.filter(F.col("month") <= F.lit(last).cast("date"))
    return out


def add_reports(
    panel: DataFrame, raw_reports: DataFrame, max_age: int = names.MAX_REPORT_AGE_MONTHS, split: str | None = None
) -> DataFrame:
    """Panel with the latest report that was public at each month; ``split`` solves long histories piece by piece."""
    reports = accounting.report_growth(accounting.report_measures(accounting.standardise_reports(raw_reports)))
    keep = ["entity", "company", "datadate", "available_month", "sic2"]
    measures = [c for c in names.ACCOUNTING_CHARACTERISTICS if c != "has_compustat_annual"]
    available = accounting.with_availability(reports).select(*keep, *measures)
    return accounting.merge_reports(panel, available, max_age=max_age, split=split)


def base_dataset(
    panel: DataFrame, macro: DataFrame, macro_columns: Sequence[str], characteristics: Sequence[str] = names.CHARACTERISTICS,
    market_columns: Sequence[str] = names.MARKET_COLUMNS, code: str = "sic2", is_stored: bool = False,
) -> tuple[DataFrame, list[str]]:
    """Keys, target and base predictors: characteristics, market, last month's macro state, industry dummies.

    The list of dummies is read off the panel, which is stored first unless ``is_stored``.
    """
    panel = panel if is_stored else cut_lineage(panel)
    coded, dummies = crosssection.one_hot(panel, code, "sic2")
    with_macro = join_lagged_period(coded, macro, "month", "month", 1)
    predictors = [*characteristics, *market_columns, *macro_columns, *dummies]
    return select_contract(with_macro, ["entity", "month", names.TARGET], predictors), predictors


def model_dataset(
    base: DataFrame, predictors: Sequence[str], macro_columns: Sequence[str],
    continuous: Sequence[str] = names.CONTINUOUS_CHARACTERISTICS, binary: Sequence[str] = names.BINARY_CHARACTERISTICS,
    is_stored: bool = False,
) -> tuple[DataFrame, list[str]]:
    """Imputed, clipped dataset with interactions, first month dropped.

    ``is_stored``: the base is a stored table, or a cheap projection of one, and may be read several times.
    """
    flags = crosssection.fill_flags(drop_first_period(base, "month"), list(binary))
    cleaned = crosssection.impute_and_winsorize(flags, "month", list(continuous), is_stored=is_stored)
    crossed, made = crosssection.interactions(cleaned, list(continuous), list(macro_columns))
    contract = [*predictors, *made]
    return select_contract(crossed, ["entity", "month", names.TARGET], contract), contract


def dataset_checks(dataset: DataFrame, contract: Sequence[str], strict: bool = True) -> DataFrame:
    """No NULL, no infinity, no repeated key in the final table."""
    numeric = [names.TARGET, *contract]
    checks = [quality.no_nulls(["entity", "month", *numeric]), quality.no_infinities(numeric)]
    return quality.expect(dataset, checks, unique=["entity", "month"], strict=strict)


def macro_problems(macro: DataFrame, columns: Sequence[str], varying: Sequence[str], max_run: int = names.MAX_CONSTANT_RUN) -> DataFrame:
    """Checks on a monthly state table (check, failures, ok): unique and continuous months, no gaps, no stale series."""
    base = quality.expect(macro, [quality.no_nulls(["month", *columns])], unique=["month"])
    gaps = islands.month_sequence_gaps(macro, "month").agg(F.lit("missing_months").alias("check"), F.count(F.lit(1)).alias("failures"))
    stale = [
        islands.longest_run(macro, [], "month", c).select(
            F.lit(f"stale_{c}").alias("check"), F.when(F.col("length") > max_run, F.col("length")).otherwise(0).alias("failures")
        )
        for c in varying
    ]
    return union_all(base, *[part.withColumn("ok", F.col("failures") == 0) for part in (gaps, *stale)])


def dataset_summary(dataset: DataFrame, contract: Sequence[str]) -> DataFrame:
    """Item-value summary of a model dataset."""
    numeric = [names.TARGET, *contract]
    return quality.key_value_summary(
        dataset,
        {
            "final_rows": F.count(F.lit(1)),
            "final_columns": F.lit(len(dataset.columns)),
            "final_predictors": F.lit(len(contract)),
            "sic2_dummies": F.lit(sum(c.startswith("sic2_") for c in contract)),
            "interactions": F.lit(sum("_x_" in c for c in contract)),
            "unique_entities": F.count_distinct("entity"),
            "first_month": F.min("month"),
            "last_month": F.max("month"),
            "rows_without_report": F.count_if(F.col("has_compustat_annual") == 0) if "has_compustat_annual" in contract else F.lit(None),
            "missing_values": quality.no_nulls(numeric).failures,
            "infinite_values": quality.no_infinities(numeric).failures,
        },
    )
