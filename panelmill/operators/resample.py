"""Calendar resampling of daily bars and period series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions.scalars import month_end, null_out, safe_ratio
from panelmill.operators.relational import calendar_side, join_period, one_row_per
from panelmill.operators.timeline import gap_aware_return, pct_change, rolling_beta


def last_value(col: Column | str, time: Column | str) -> Column:
    """Last non-NULL value of a group in time order; mergeable, so it is combined map-side."""
    c = F.col(col) if isinstance(col, str) else col
    t = F.col(time) if isinstance(time, str) else time
    return F.max_by(c, F.when(c.isNotNull(), t))


def mean_of_top(df: DataFrame, keys: list[str], value: str, k: int, out: str) -> DataFrame:
    """Mean of the k largest values per group (of fewer if there are fewer, NULL if none).

    The row limit per group is applied in every input partition before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(value))
    top = df.select(*keys, value, F.row_number().over(w).alias("__rn")).filter(F.col("__rn") <= k)
    return top.groupBy(*keys).agg(F.avg(value).alias(out))


def resample_monthly(bars: DataFrame, entity: str, date: str) -> DataFrame:
    """Daily bars (one row per entity and day) to monthly price, risk and liquidity measures.

    The daily return needs rows of one entity together, so data are shuffled once by entity;
    the month ranks and the group-by reuse that partitioning. A month has at most 31 rows.
    """
    w = Window.partitionBy(entity).orderBy(date)
    dolvol = F.col("adj_close") * F.col("volume")
    daily = bars.select(
        entity,
        F.col(date).alias("__date"),
        month_end(date).alias("month"),
        "adj_close",
        pct_change("adj_close", w).alias("ret"),
        dolvol.alias("dolvol"),
        F.log1p(dolvol).alias("log_dolvol"),
        F.coalesce(F.col("volume") == 0, F.lit(False)).cast("double").alias("zero_volume"),
        safe_ratio(F.col("high") - F.col("low"), "close").alias("range"),
    )
    by_size = Window.partitionBy(entity, "month").orderBy(F.desc_nulls_last("ret"))
    daily = daily.select(
        "*",
        F.try_divide(F.abs("ret"), F.when(F.col("dolvol") > 0, F.col("dolvol"))).alias("amihud"),
        F.row_number().over(by_size).alias("__rn"),
    )
    monthly = daily.groupBy(entity, "month").agg(
        F.count(F.lit(1)).alias("n_trading_days"),
        last_value("adj_close", "__date").alias("last_adj_close"),
        F.avg("dolvol").alias("avg_dolvol_1m"),
        F.stddev_samp("dolvol").alias("std_dolvol_1m"),
        F.avg("log_dolvol").alias("avg_log_dolvol_1m"),
        F.stddev_samp("ret").alias("retvol_1m"),
        F.min("ret").alias("minret_1m"),
        F.avg(F.when(F.col("__rn") <= 5, F.col("ret"))).alias("rmax5_21d"),
        F.avg("amihud").alias("amihud_1m"),
        F.avg("zero_volume").alias("zerotrade_1m"),
        F.avg("range").alias("avg_range_1m"),
    )
    volume_based = ["avg_dolvol_1m", "std_dolvol_1m", "avg_log_dolvol_1m", "amihud_1m", "zerotrade_1m"]
    return null_out(monthly, F.col("avg_dolvol_1m") == 0, volume_based)


def daily_returns(bars: DataFrame, entity: str, date: str) -> DataFrame:
    w = Window.partitionBy(entity).orderBy(date)
    return bars.select(entity, date, pct_change("adj_close", w).alias("ret"))


def series_returns(series: DataFrame, date: str, price: str, out: str) -> DataFrame:
    """Returns of one date-grain series (at most one row per calendar day, hence one small window)."""
    w = Window.partitionBy(F.lit(0)).orderBy(date)
    return series.select(date, price, pct_change(price, w).alias(out))


def market_monthly(market: DataFrame, date: str, price: str) -> DataFrame:
    """Monthly market return (gap-aware) and volatility of daily returns."""
    daily = series_returns(market, date, price, "__ret")
    monthly = daily.groupBy(month_end(date).alias("month")).agg(
        last_value(price, date).alias("__last"), F.stddev_samp("__ret").alias("market_vol_1m")
    )
    out = gap_aware_return(monthly, None, "month", "__last", "market_ret_1m")
    return out.select("month", "market_ret_1m", "market_vol_1m")


def level_monthly(series: DataFrame, date: str, level: str) -> DataFrame:
    """Monthly mean of a level series and the gap-aware change of its last value."""
    monthly = series.groupBy(month_end(date).alias("month")).agg(
        last_value(level, date).alias("__last"), F.avg(level).alias("vix_avg_1m")
    )
    out = gap_aware_return(monthly, None, "month", "__last", "vix_change_1m")
    return out.select("month", "vix_avg_1m", "vix_change_1m")


def monthly_risk(
    returns: DataFrame, market: DataFrame, entity: str, date: str, rows: int = 252, min_periods: int = 126,
    block_rows: int | None = None,
) -> DataFrame:
    """Month-end beta, beta squared and idiosyncratic volatility.

    ``returns`` has (entity, date, ret), ``market`` (date, market_ret); only days with both count.
    """
    dim = calendar_side(one_row_per(market.select(date, "market_ret"), date), date)
    both = returns.join(dim, date, "inner").dropna()
    risk = rolling_beta(both, entity, date, "ret", "market_ret", rows, min_periods, block_rows)
    return risk.groupBy(entity, month_end(date).alias("month")).agg(
        *[last_value(c, date).alias(c) for c in ("beta_12m", "betasq_12m", "idiovol_12m")]
    )


def add_period_features(monthly: DataFrame, *dims: DataFrame) -> DataFrame:
    for dim in dims:
        monthly = join_period(monthly, dim, "month")
    return monthly
