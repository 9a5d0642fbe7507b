"""Queries on daily bars: cleaning, resampling, returns, rolling measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmill.functions import names
from panelmill.functions.scalars import month_end
from panelmill.operators import clean, resample, timeline
from panelmill.operators.relational import keep_last, without_keys
from panelmill.plans.registry import query, r, rounded, with_views
from panelmill.plans.views_sql import DAILY, FLAGGED, MARKET, MONTHLY, PICKED, PRICES, RATES, REPORT, RESAMPLED
from panelmill.session import cut_lineage
from panelmill.sources import adapters as src

BAR_LIST = "open high low close adj_close volume"


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    """Raw bars to one flagged row per day, with limits that suit the noisy test prices."""
    one = clean.drop_repeats(src.raw_bars(spark, sf), "entity", "date", src.RAW_BAR_ORDER)
    return clean.flag_bars(one, "entity", "date", high_return=0.15)


def _report(flagged: DataFrame) -> DataFrame:
    report = clean.quality_report(flagged, "entity", "date", bad_share=0.06)
    # The test prices hold a few zero quotes per entity: two jumps are tolerated here.
    return report.withColumn("remove_entity", (F.col("bad_row_share") > 0.06) | (F.col("extreme_return_rows") > 2))


@query("dedupe_keep_last", with_views(PICKED) + f"SELECT entity, date, {r(BAR_LIST)}, dropped_rows FROM picked")
def dedupe_keep_last(spark, sf):
    out = clean.drop_repeats(src.raw_bars(spark, sf), "entity", "date", src.RAW_BAR_ORDER)
    return rounded(out.select("entity", "date", *BAR_LIST.split(), "dropped_rows"))


@query(
    "bar_flags",
    with_views(FLAGGED)
    + f"SELECT entity, date, {r('daily_ret')}, bad_ohlc, missing_core, nonpositive_price, extreme_return, bad_row FROM marked WHERE bad_row OR extreme_return",
)
def bar_flags(spark, sf):
    out = _flagged(spark, sf).filter("bad_row or extreme_return")
    cols = ["daily_ret", "bad_ohlc", "missing_core", "nonpositive_price", "extreme_return", "bad_row"]
    return rounded(out.select("entity", "date", *cols))


@query(
    "quality_report",
    with_views(REPORT)
    + f"""SELECT entity, rows, first_date, last_date, bad_ohlc_rows, missing_core_rows, nonpositive_price_rows, extreme_return_rows, bad_rows,
  {r('minimum_daily_return maximum_daily_return bad_row_share')}, duplicate_rows,
  bad_row_share > 0.06 OR extreme_return_rows > 0 AS remove_entity,
  CASE WHEN bad_row_share > 0.06 OR extreme_return_rows > 0 THEN 'removed_quality' ELSE 'retained' END AS status,
  CASE WHEN bad_row_share > 0.06 AND extreme_return_rows > 0 THEN 'bad_row_share_and_extreme_return'
       WHEN bad_row_share > 0.06 THEN 'bad_row_share_above_threshold' WHEN extreme_return_rows > 0 THEN 'extreme_adjusted_return' ELSE '' END AS removal_reason
  FROM report""",
)
def quality_report(spark, sf):
    return rounded(clean.quality_report(_flagged(spark, sf), "entity", "date", bad_share=0.06))


@query(
    "clean_bars",
    with_views(REPORT)
    + f"SELECT entity, date, {r(BAR_LIST)} FROM marked WHERE NOT bad_row AND entity NOT IN (SELECT entity FROM report WHERE remove_entity)",
)
def clean_bars(spark, sf):
    flagged = cut_lineage(_flagged(spark, sf))  # read by the report and by the filter
    return rounded(clean.clean_bars(flagged, _report(flagged), "entity", names.BAR_COLUMNS))


@query("daily_returns", with_views(DAILY) + f"SELECT entity, date, {r('ret', 8)} FROM daily")
def daily_returns(spark, sf):
    return rounded(resample.daily_returns(src.bars(spark, sf), "entity", "date"), 8)


RESAMPLED_LIST = (
    "last_adj_close avg_log_dolvol_1m retvol_1m minret_1m rmax5_21d zerotrade_1m avg_range_1m"
)


@query(
    "monthly_resample",
    with_views(RESAMPLED)
    + f"SELECT entity, month, n_trading_days, {r(RESAMPLED_LIST, 5)}, {r('avg_dolvol_1m std_dolvol_1m', 3)}, {r('amihud_1m', 10)} FROM resampled",
)
def monthly_resample(spark, sf):
    out = resample.resample_monthly(src.bars(spark, sf), "entity", "date")
    return rounded(out, 5, avg_dolvol_1m=3, std_dolvol_1m=3, amihud_1m=10)


@query(
    "top5_mean",
    with_views(DAILY)
    + """SELECT entity, month, round(avg(ret), 8) + 0.0 AS top5 FROM
  (SELECT *, row_number() OVER (PARTITION BY entity, month ORDER BY ret DESC NULLS LAST) AS rn FROM daily) WHERE rn <= 5 GROUP BY entity, month""",
)
def top5_mean(spark, sf):
    daily = resample.daily_returns(src.bars(spark, sf), "entity", "date").withColumn("month", month_end("date"))
    return rounded(resample.mean_of_top(daily, ["entity", "month"], "ret", 5, "top5"), 8)


@query(
    "last_non_null",
    with_views(PICKED)
    + "SELECT entity, last_day(date) AS month, arg_max(volume, date) FILTER (volume IS NOT NULL) AS last_volume, max(date) AS last_date FROM picked GROUP BY 1, 2",
)
def last_non_null(spark, sf):
    one = keep_last(src.raw_bars(spark, sf), ["entity", "date"], src.RAW_BAR_ORDER)
    return one.groupBy("entity", month_end("date").alias("month")).agg(
        resample.last_value("volume", "date").alias("last_volume"), F.max("date").alias("last_date")
    )


@query("gap_aware_return", with_views(PRICES) + f"SELECT entity, month, {r('last_adj_close')}, {r('ret_1m', 8)}, ret_1m_gap FROM prices")
def gap_aware_return(spark, sf):
    return rounded(src.monthly_prices(spark, sf), 8, last_adj_close=6)


TARGET_SQL = """, led AS (
  SELECT *, lead(month) OVER w AS following, lead(ret_1m) OVER w AS ret_next FROM prices WINDOW w AS (PARTITION BY entity ORDER BY month)),
targets AS (
  SELECT entity, led.month, CASE WHEN following = last_day(led.month + INTERVAL 1 DAY) THEN ret_next END AS target_return_next_1m,
         following IS NOT NULL AND following <> last_day(led.month + INTERVAL 1 DAY) AS target_excess_return_next_1m_gap, rate AS rf_next_1m
  FROM led LEFT JOIN rates ON rates.month = last_day(led.month + INTERVAL 1 DAY))"""


@query(
    "next_month_target",
    with_views(PRICES, RATES)
    + TARGET_SQL
    + f"""SELECT entity, month, {r('target_return_next_1m rf_next_1m', 8)}, target_excess_return_next_1m_gap,
  round(target_return_next_1m - rf_next_1m, 8) + 0.0 AS target_excess_return_next_1m FROM targets""",
)
def next_month_target(spark, sf):
    out = timeline.next_period_target(
        src.monthly_prices(spark, sf), "entity", "month", "ret_1m", src.rates(spark, sf), "rate", names.TARGET
    )
    cols = ["entity", "month", "target_return_next_1m", "rf_next_1m", f"{names.TARGET}_gap", names.TARGET]
    return rounded(out.select(*cols), 8)


def _rolling_product(rows: int) -> str:
    frame = f"OVER (PARTITION BY entity ORDER BY month ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(ret_1m) {frame} = {rows} THEN product(1 + ret_1m) {frame} - 1 END"


@query(
    "rolling_momentum",
    with_views(PRICES)
    + f"""SELECT entity, month, round({_rolling_product(6)}, 9) + 0.0 AS mom6m, round({_rolling_product(12)}, 9) + 0.0 AS mom12m,
  round({_rolling_product(36)}, 9) + 0.0 AS long_term_return_36m FROM prices""",
)
def rolling_momentum(spark, sf):
    m = src.monthly_prices(spark, sf)
    w = Window.partitionBy("entity").orderBy("month")
    spans = {"mom6m": 6, "mom12m": 12, "long_term_return_36m": 36}
    return rounded(m.select("entity", "month", *[timeline.compounded_return("ret_1m", n, w).alias(c) for c, n in spans.items()]), 9)


_W12 = "OVER (PARTITION BY entity ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"


@query(
    "rolling_trend",
    with_views(MONTHLY)
    + f"""SELECT entity, month, round(CASE WHEN count(retvol_1m) {_W12} = 12 THEN avg(retvol_1m) {_W12} END, 7) + 0.0 AS retvol12m,
  round(avg_dolvol_1m / CASE WHEN lag(avg_dolvol_1m) OVER w > 0 THEN lag(avg_dolvol_1m) OVER w END - 1, 7) + 0.0 AS dolvol_growth_1m,
  round(CASE WHEN count(last_adj_close) {_W12} = 12 THEN last_adj_close / avg(last_adj_close) {_W12} END, 7) + 0.0 AS price_to_ma12,
  round(CASE WHEN count(last_adj_close) {_W12} = 12 THEN last_adj_close / max(last_adj_close) {_W12} - 1 END, 7) + 0.0 AS dist_from_high_12m
  FROM monthly WINDOW w AS (PARTITION BY entity ORDER BY month)""",
)
def rolling_trend(spark, sf):
    monthly = resample.resample_monthly(src.bars(spark, sf), "entity", "date")
    with_ret = timeline.gap_aware_return(monthly, "entity", "month", "last_adj_close", "ret_1m")
    out = timeline.price_trends(with_ret, "entity", "month")
    return rounded(out.select("entity", "month", "retvol12m", "dolvol_growth_1m", "price_to_ma12", "dist_from_high_12m"), 7)


_W6 = "OVER (PARTITION BY entity ORDER BY month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"


@query(
    "rolling_statistics",
    with_views(PRICES)
    + "SELECT entity, month, "
    + ", ".join(
        f"round(CASE WHEN count(ret_1m) {_W6} >= 3 THEN {fn}(ret_1m) {_W6} END, 8) + 0.0 AS {out}"
        for out, fn in [("mean6", "avg"), ("sum6", "sum"), ("var6", "var_samp"), ("std6", "stddev_samp"), ("min6", "min"), ("max6", "max")]
    )
    + " FROM prices",
)
def rolling_statistics(spark, sf):
    m = src.monthly_prices(spark, sf)
    w = Window.partitionBy("entity").orderBy("month")
    made = [timeline.rolling("ret_1m", fn, 6, w, min_periods=3).alias(f"{fn}6") for fn in ("mean", "sum", "var", "std", "min", "max")]
    return rounded(m.select("entity", "month", *made), 8)


_BETA_FRAME = "OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
BETA_SQL = (
    with_views(DAILY, MARKET)
    + f""", market_ret AS (SELECT date, adj_close / lag(adj_close) OVER (ORDER BY date) - 1 AS mret FROM market),
both_sides AS (SELECT entity, date, ret, mret FROM daily JOIN market_ret USING (date) WHERE ret IS NOT NULL AND mret IS NOT NULL),
moments AS (
  SELECT entity, date, CASE WHEN count(*) {_BETA_FRAME} >= 126 THEN covar_samp(ret, mret) {_BETA_FRAME} END AS cov,
         var_samp(mret) {_BETA_FRAME} AS vm, var_samp(ret) {_BETA_FRAME} AS vs FROM both_sides),
risk AS (
  SELECT entity, date, last_day(date) AS month, cov / nullif(vm, 0) AS beta,
         sqrt(greatest(vs - (cov / nullif(vm, 0)) ** 2 * vm, 0)) AS idio FROM moments)
SELECT entity, month, round(arg_max(beta, date), 7) + 0.0 AS beta_12m, round(arg_max(beta ** 2, date), 7) + 0.0 AS betasq_12m,
       round(arg_max(CASE WHEN beta IS NOT NULL THEN idio END, date), 7) + 0.0 AS idiovol_12m
FROM risk GROUP BY entity, month"""
)


def _risk(spark, sf, block_rows=None):
    returns = resample.daily_returns(src.bars(spark, sf), "entity", "date")
    market = resample.series_returns(src.market(spark, sf), "date", "adj_close", "market_ret").select("date", "market_ret")
    return resample.monthly_risk(returns, market, "entity", "date", block_rows=block_rows)


@query("rolling_beta", BETA_SQL)
def rolling_beta(spark, sf):
    return rounded(_risk(spark, sf), 7)


@query("rolling_beta_split_histories", BETA_SQL)
def rolling_beta_split_histories(spark, sf):
    """The same measures with every history cut into blocks, as for entities with very long histories."""
    return rounded(_risk(spark, sf, block_rows=300), 7)


@query(
    "market_features",
    with_views(MARKET)
    + """, daily AS (SELECT *, last_day(date) AS month, adj_close / lag(adj_close) OVER (ORDER BY date) - 1 AS ret FROM market),
m AS (SELECT month, arg_max(adj_close, date) AS p, stddev_samp(ret) AS market_vol_1m, arg_max(level, date) AS lv, avg(level) AS vix_avg_1m FROM daily GROUP BY month),
g AS (SELECT *, lag(month) OVER (ORDER BY month) AS before, lag(p) OVER (ORDER BY month) AS pb, lag(lv) OVER (ORDER BY month) AS lb FROM m)
SELECT month, round(CASE WHEN month = last_day(before + INTERVAL 1 DAY) THEN p / pb - 1 END, 8) + 0.0 AS market_ret_1m, round(market_vol_1m, 8) + 0.0 AS market_vol_1m,
  round(vix_avg_1m, 8) + 0.0 AS vix_avg_1m, round(CASE WHEN month = last_day(before + INTERVAL 1 DAY) THEN lv / lb - 1 END, 8) + 0.0 AS vix_change_1m FROM g""",
)
def market_features(spark, sf):
    daily = src.market(spark, sf)
    price = resample.market_monthly(daily, "date", "adj_close")
    level = resample.level_monthly(daily, "date", "level")
    return rounded(price.join(level, "month"), 8)


@query(
    "missing_months",
    """WITH m AS (SELECT DISTINCT o_custkey AS entity, last_day(CAST(o_orderdate AS DATE)) AS month FROM orders)
SELECT entity, month, year(month) * 12 + month(month) - lag(year(month) * 12 + month(month)) OVER (PARTITION BY entity ORDER BY month) - 1 AS missing_months FROM m""",
)
def missing_months(spark, sf):
    months = _customer_months(spark, sf)
    return timeline.missing_periods(months, "entity", "month").select("entity", "month", F.col("missing_months").cast("long").alias("missing_months"))


def _customer_months(spark, sf):
    orders = src.table(spark, sf, "orders")
    return orders.select(F.col("o_custkey").alias("entity"), month_end("o_orderdate").alias("month")).distinct()


@query(
    "fragmented_removal",
    """WITH m AS (SELECT DISTINCT o_custkey AS entity, last_day(CAST(o_orderdate AS DATE)) AS month FROM orders),
g AS (SELECT *, year(month) * 12 + month(month) - lag(year(month) * 12 + month(month)) OVER (PARTITION BY entity ORDER BY month) - 1 AS gap FROM m),
bad AS (SELECT entity FROM g GROUP BY entity HAVING max(gap) > 20)
SELECT o_custkey AS entity, o_orderkey, round(o_totalprice, 2) + 0.0 AS o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT entity FROM bad)""",
)
def fragmented_removal(spark, sf):
    orders = src.table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), "o_orderkey", "o_totalprice")
    bad = timeline.fragmented_entities(_customer_months(spark, sf), "entity", "month", 20)
    return rounded(without_keys(orders, bad, ["entity"]), 2)
