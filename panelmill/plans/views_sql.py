"""SQL text of the adapter views, shared by the checking queries."""

LINES = """lines AS (
  SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS date, 100 * (1 + l_discount + l_tax) AS px, l_quantity AS q,
         l_orderkey, l_linenumber, l_partkey, l_extendedprice
  FROM lineitem)"""

BARS = LINES + """, bars AS (
  SELECT entity, date, round(avg(px), 6) AS open, max(px) AS high, min(px) AS low,
         round(sum(px * q) / sum(q), 6) AS close, round(sum(px * q) / sum(q), 6) AS adj_close, sum(q) AS volume
  FROM lines GROUP BY entity, date)"""

RAW_BARS = LINES + """, raw_bars AS (
  SELECT entity, date, px AS open,
         CASE WHEN l_orderkey % 50 = 0 THEN px - 1 ELSE px + 1 END AS high,
         CASE WHEN l_orderkey % 50 = 0 THEN px + 1 ELSE px - 1 END AS low,
         px AS close, CASE WHEN l_partkey % 211 <> 0 THEN px ELSE 0.0 END AS adj_close,
         CASE WHEN q <> 1 THEN q END AS volume, l_orderkey, l_linenumber, l_partkey, l_extendedprice
  FROM lines)"""

PICKED = RAW_BARS + """, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY entity, date ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS rn,
         count(*) OVER (PARTITION BY entity, date) - 1 AS dropped_rows
  FROM raw_bars), picked AS (SELECT * FROM numbered WHERE rn = 1)"""

# Parameters high, low: thresholds of the extreme-return flag.
FLAGGED = PICKED + """, lagged AS (
  SELECT *, lag(adj_close) OVER (PARTITION BY entity ORDER BY date) AS before FROM picked),
flagged AS (
  SELECT *, adj_close / nullif(before, 0) - 1 AS daily_ret,
         coalesce(high < low, false) OR coalesce(high < open, false) OR coalesce(high < close, false)
           OR coalesce(low > open, false) OR coalesce(low > close, false) AS bad_ohlc,
         (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR adj_close IS NULL OR volume IS NULL) AS missing_core,
         (coalesce(open <= 0, false) OR coalesce(high <= 0, false) OR coalesce(low <= 0, false) OR coalesce(close <= 0, false)
           OR coalesce(adj_close <= 0, false)) AS nonpositive_price,
         coalesce(adj_close / nullif(before, 0) - 1 > 0.15 OR adj_close / nullif(before, 0) - 1 < -0.95, false)
           OR coalesce(before = 0 AND adj_close <> 0, false) AS extreme_return
  FROM lagged), marked AS (SELECT *, bad_ohlc OR missing_core OR nonpositive_price AS bad_row FROM flagged)"""

REPORT = FLAGGED + """, counted AS (
  SELECT entity, count(*) AS rows, min(date) AS first_date, max(date) AS last_date,
         count(*) FILTER (bad_ohlc) AS bad_ohlc_rows, count(*) FILTER (missing_core) AS missing_core_rows,
         count(*) FILTER (nonpositive_price) AS nonpositive_price_rows, count(*) FILTER (extreme_return) AS extreme_return_rows,
         count(*) FILTER (bad_row) AS bad_rows, min(daily_ret) AS minimum_daily_return, max(daily_ret) AS maximum_daily_return,
         CAST(sum(dropped_rows) AS BIGINT) AS duplicate_rows
  FROM marked GROUP BY entity),
report AS (
  SELECT *, bad_rows / rows AS bad_row_share, (bad_rows / rows > 0.06) OR extreme_return_rows > 2 AS remove_entity
  FROM counted)"""

MARKET = """market AS (
  SELECT CAST(o_orderdate AS DATE) AS date, round(avg(o_totalprice), 4) AS adj_close, CAST(count(*) AS DOUBLE) AS level
  FROM orders GROUP BY 1)"""

RATES = """rates AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS month, count(*) / 1e6 AS rate FROM orders GROUP BY 1)"""

MACRO = """macro AS (
  SELECT last_day(CAST(o_orderdate AS DATE)) AS month, avg(o_totalprice) / 1e5 AS m1, stddev_samp(o_totalprice) / 1e5 AS m2,
         avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END) AS m3,
         avg(CASE WHEN o_orderpriority = '5-LOW' THEN 1.0 ELSE 0.0 END) AS m4
  FROM orders GROUP BY 1)"""

DAILY = BARS + """, daily AS (
  SELECT *, last_day(date) AS month, adj_close / lag(adj_close) OVER (PARTITION BY entity ORDER BY date) - 1 AS ret,
         adj_close * volume AS dolvol
  FROM bars)"""

RESAMPLED = DAILY + """, ordered AS (
  SELECT *, row_number() OVER (PARTITION BY entity, month ORDER BY ret DESC NULLS LAST) AS rn FROM daily),
resampled AS (
  SELECT entity, month, count(*) AS n_trading_days, arg_max(adj_close, date) AS last_adj_close,
         avg(dolvol) AS avg_dolvol_1m, stddev_samp(dolvol) AS std_dolvol_1m, avg(ln(1 + dolvol)) AS avg_log_dolvol_1m,
         stddev_samp(ret) AS retvol_1m, min(ret) AS minret_1m, avg(CASE WHEN rn <= 5 THEN ret END) AS rmax5_21d,
         avg(abs(ret) / CASE WHEN dolvol > 0 THEN dolvol END) AS amihud_1m,
         avg(CASE WHEN volume = 0 THEN 1.0 ELSE 0.0 END) AS zerotrade_1m, avg((high - low) / nullif(close, 0)) AS avg_range_1m
  FROM ordered GROUP BY entity, month)"""


def _gap_return(source: str, name: str) -> str:
    return f""", {name} AS (
  SELECT *, before IS NOT NULL AND month <> last_day(before + INTERVAL 1 DAY) AS ret_1m_gap,
         CASE WHEN before IS NULL OR month = last_day(before + INTERVAL 1 DAY) THEN last_adj_close / nullif(price_before, 0) - 1 END AS ret_1m
  FROM (SELECT *, lag(month) OVER w AS before, lag(last_adj_close) OVER w AS price_before FROM {source}
        WINDOW w AS (PARTITION BY entity ORDER BY month)))"""


PRICES = BARS + """, last_prices AS (
  SELECT entity, last_day(date) AS month, arg_max(adj_close, date) AS last_adj_close FROM bars GROUP BY 1, 2)""" + _gap_return(
    "last_prices", "prices"
)

MONTHLY = RESAMPLED + _gap_return("resampled", "monthly")

ANNUAL = """yearly AS (
  SELECT l_suppkey, year(l_shipdate) AS yr, round(sum(l_extendedprice), 2) AS assets, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sale,
         round(sum(l_quantity), 2) AS invt, round(sum(l_tax), 2) AS dlc, count(*) AS n
  FROM lineitem GROUP BY 1, 2),
annual AS (
  SELECT 'S' || l_suppkey AS entity, CAST(l_suppkey AS VARCHAR) AS company, make_date(yr, 12, 31) AS datadate, n,
         assets, sale, invt, dlc, CASE WHEN n % 5 <> 0 THEN assets * 0.4 END AS ceq, CASE WHEN n % 3 <> 0 THEN assets * 0.3 END AS seq,
         assets * 0.55 AS lt, CASE WHEN n % 4 <> 0 THEN sale * 0.6 END AS cogs, CASE WHEN n % 2 <> 0 THEN sale * 0.05 END AS xrd,
         CASE WHEN n % 7 <> 0 THEN sale * 0.12 END AS oiadp, sale * 0.02 - invt AS oancf,
         CASE WHEN n % 6 = 0 THEN 0.0 ELSE invt * 3 END AS lct, invt * 5 AS act, invt * 2 AS ppegt, invt + dlc AS capx,
         invt / 10 AS csho, -assets / 1e5 AS prcc_f, CASE WHEN n % 8 <> 0 THEN dlc END AS dvt, dlc AS che, dlc AS rect,
         sale * 0.01 AS ib, s_nationkey * 100 + 5 AS sic
  FROM yearly LEFT JOIN supplier ON l_suppkey = s_suppkey WHERE n % 97 <> 0)"""

PREDICTIONS = PRICES + """, base AS (
  SELECT * FROM (SELECT entity, month, ret_1m AS realized_target, lag(ret_1m) OVER (PARTITION BY entity ORDER BY month) AS lag1 FROM prices)
  WHERE realized_target IS NOT NULL AND lag1 IS NOT NULL),
mean AS (SELECT round(avg(realized_target), 9) AS mean FROM base WHERE month <= DATE '1999-12-31'),
forecasts AS (
  SELECT 'historical_mean' AS model, base.*, mean AS prediction, mean AS benchmark FROM base, mean
  UNION ALL SELECT 'lag', base.*, lag1, mean FROM base, mean
  UNION ALL SELECT 'half_lag', base.*, lag1 * 0.5, mean FROM base, mean),
predictions AS (
  SELECT model, CASE WHEN month <= DATE '1999-12-31' THEN 'validation' ELSE 'test' END AS sample, entity, month, realized_target,
         prediction, benchmark
  FROM forecasts)"""


def metrics(source: str, keys: str, name: str) -> str:
    """Metric bundle over a prediction view, grouped by ``keys``."""
    return f""", {name}_months AS (
  SELECT {keys}, month, avg((realized_target - prediction) ** 2) AS mse, avg((realized_target - benchmark) ** 2) AS mse_b FROM {source}
  GROUP BY {keys}, month),
{name}_weighted AS (
  SELECT {keys}, avg(mse) AS monthly_mse, avg(mse_b) AS monthly_b, count(*) AS months FROM {name}_months GROUP BY {keys}),
{name}_pooled AS (
  SELECT {keys}, count(*) AS observations, avg((realized_target - prediction) ** 2) AS pooled_mse,
         avg(abs(realized_target - prediction)) AS pooled_mae, sum((realized_target - prediction) ** 2) AS sse,
         sum((realized_target - benchmark) ** 2) AS sse_b, avg(prediction) AS prediction_mean, stddev_pop(prediction) AS prediction_std,
         covar_pop(realized_target, prediction) AS cov, stddev_pop(realized_target) AS std_y
  FROM {source} GROUP BY {keys}),
{name} AS (
  SELECT {keys}, observations, months, pooled_mse, sqrt(pooled_mse) AS pooled_rmse, pooled_mae, monthly_mse, sqrt(monthly_mse) AS monthly_rmse,
         CASE WHEN sse_b > 0 THEN 1 - sse / sse_b END AS oos_r2, CASE WHEN monthly_b > 0 THEN 1 - monthly_mse / monthly_b END AS monthly_oos_r2,
         CASE WHEN prediction_std > 1e-8 THEN cov / nullif(prediction_std * std_y, 0) END AS prediction_target_correlation,
         prediction_mean, prediction_std
  FROM {name}_pooled JOIN {name}_weighted USING ({keys}))"""


METRIC_COLUMNS = (
    "pooled_mse pooled_rmse pooled_mae monthly_mse monthly_rmse oos_r2 monthly_oos_r2 prediction_target_correlation "
    "prediction_mean prediction_std"
)

YEARLY = PREDICTIONS + """, with_year AS (SELECT *, year(month) AS year FROM predictions)""" + metrics("with_year", "model, year", "yearly")
