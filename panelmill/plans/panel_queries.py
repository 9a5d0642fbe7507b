"""Queries on reports, cross-sections and the assembled panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.functions import names
from panelmill.functions.scalars import (
    clip, days_apart_between, first_present, month_end, month_number, numbered_id, parse_yyyymm, positive_log, safe_ratio,
    shift_month_end, sqrt_nonnegative,
)
from panelmill.operators import accounting, crosssection, islands, quality, relational, resample, timeline
from panelmill.operators.quantiles import group_quantiles
from panelmill.plans import panel
from panelmill.plans.registry import query, r, rounded, with_views
from panelmill.plans.views_sql import ANNUAL, MACRO, MARKET, MONTHLY, PRICES, RATES
from panelmill.sources import adapters as src

_LEVELS = """, levels AS (
  SELECT *, CASE WHEN coalesce(seq, ceq + 0.0, assets - lt) + 0.0 - 0.0 > 0 THEN coalesce(seq, ceq + 0.0, assets - lt) + 0.0 - 0.0 END AS book_equity,
         abs(prcc_f) * csho AS market_equity, coalesce(dlc, 0) + 0.0 AS debt_total, coalesce(xrd, 0) AS xrd_filled,
         coalesce(oiadp, sale - cogs - 0.0 + coalesce(xrd, 0)) AS operating_profit
  FROM annual),
measures AS (
  SELECT entity, company, datadate, n, assets, sale, invt, ppegt, capx,
         book_equity / nullif(market_equity, 0) AS be_me, oancf / nullif(market_equity, 0) AS ocf_me, operating_profit / nullif(assets, 0) AS op_at,
         oancf / nullif(assets, 0) AS ocf_at, debt_total / nullif(assets, 0) AS debt_at, che / nullif(assets, 0) AS cash_at,
         oancf / nullif(debt_total, 0) AS cashflow_to_debt, act / nullif(lct, 0) AS current_ratio, (act - invt) / nullif(lct, 0) AS quick_ratio,
         capx / nullif(assets, 0) AS capx_at, xrd_filled / nullif(assets, 0) AS rd_at,
         (che + 0.715 * rect + 0.547 * invt + 0.535 * ppegt) / nullif(assets, 0) AS tangibility, sale / nullif(assets, 0) AS asset_turnover,
         sale / nullif(invt, 0) AS sales_to_inventory, sale / nullif(che, 0) AS sales_to_cash, sale / nullif(rect, 0) AS sales_to_receivables,
         (ib - oancf) / nullif(assets, 0) AS accruals_at, CASE WHEN market_equity > 0 THEN ln(market_equity) END AS log_comp_market_equity,
         CASE WHEN coalesce(dvt, 0) > 0 THEN 1 ELSE 0 END AS dividend_dummy, CASE WHEN xrd IS NULL THEN 1 ELSE 0 END AS xrd_missing,
         floor(sic / 100) AS sic2
  FROM levels)"""
_RATIOS = (
    "be_me ocf_me op_at ocf_at debt_at cash_at current_ratio quick_ratio capx_at rd_at tangibility asset_turnover "
    "sales_to_inventory accruals_at log_comp_market_equity"
)
_BIG_RATIOS = "cashflow_to_debt sales_to_cash sales_to_receivables"


def _measures(spark, sf):
    return accounting.report_measures(accounting.standardise_reports(src.annual(spark, sf)))


@query(
    "report_measures",
    with_views(ANNUAL)
    + _LEVELS
    + f"SELECT entity, company, datadate, {r(_RATIOS, 7)}, {r(_BIG_RATIOS, 1)}, dividend_dummy, xrd_missing, sic2 FROM measures",
)
def report_measures(spark, sf):
    cols = [*_RATIOS.split(), *_BIG_RATIOS.split(), "dividend_dummy", "xrd_missing", "sic2"]
    return rounded(_measures(spark, sf).select("entity", "company", "datadate", *cols), 7, **{c: 1 for c in _BIG_RATIOS.split()})


_GROWTH = """, spaced AS (
  SELECT *, datediff('day', lag(datadate) OVER w, datadate) BETWEEN 300 AND 430 AS ok, lag(assets) OVER w AS at0, lag(sale) OVER w AS sale0,
         lag(capx) OVER w AS capx0, lag(ppegt + invt) OVER w AS pi0
  FROM {source} WINDOW w AS (PARTITION BY company ORDER BY datadate)),
growth AS (
  SELECT *, CASE WHEN ok THEN (assets - at0) / nullif(at0, 0) END AS asset_growth, CASE WHEN ok THEN (sale - sale0) / nullif(sale0, 0) END AS sales_growth,
         CASE WHEN ok THEN (capx - capx0) / nullif(capx0, 0) END AS capx_growth,
         CASE WHEN ok THEN (ppegt + invt - pi0) / nullif(at0, 0) END AS ppeinv_gr1a
  FROM spaced)"""
_GROWTHS = "asset_growth sales_growth capx_growth ppeinv_gr1a"


@query("annual_growth", with_views(ANNUAL) + _GROWTH.format(source="annual") + f"SELECT entity, datadate, {r(_GROWTHS, 8)} FROM growth")
def annual_growth(spark, sf):
    reports = accounting.standardise_reports(src.annual(spark, sf))
    return rounded(accounting.report_growth(reports).select("entity", "datadate", *_GROWTHS.split()), 8)


_AVAILABLE = with_views(ANNUAL, PRICES) + """, reports AS (
  SELECT entity, company, datadate, last_day(datadate + INTERVAL 6 MONTH) AS available_month, sale / assets AS asset_turnover FROM annual),
grid AS (SELECT 'S' || entity AS entity, month, ret_1m FROM prices),
matched AS (SELECT g.entity, g.month, g.ret_1m, x.company, x.datadate, x.available_month, x.asset_turnover
            FROM grid g ASOF LEFT JOIN reports x ON g.entity = x.entity AND g.month >= x.available_month)"""


def _grid(spark, sf):
    m = src.monthly_prices(spark, sf)
    return m.select(F.concat(F.lit("S"), F.col("entity")).alias("entity"), "month", "ret_1m")


def _available(spark, sf):
    reports = accounting.standardise_reports(src.annual(spark, sf)).withColumn("asset_turnover", safe_ratio("sale", "at"))
    return accounting.with_availability(reports).select("entity", "company", "datadate", "available_month", "asset_turnover")


_ASOF_SQL = _AVAILABLE + f"SELECT entity, month, {r('ret_1m', 8)}, company, datadate, available_month, {r('asset_turnover', 8)} FROM matched"


@query("asof_reports", _ASOF_SQL)
def asof_reports(spark, sf):
    out = relational.asof_join(_grid(spark, sf), _available(spark, sf), ["entity"], "month", "available_month")
    return rounded(out, 8)


@query("asof_reports_split_histories", _ASOF_SQL)
def asof_reports_split_histories(spark, sf):
    """The same join with each history solved year by year."""
    out = relational.asof_join(_grid(spark, sf), _available(spark, sf), ["entity"], "month", "available_month", split="year")
    return rounded(out, 8)


_STALE = _AVAILABLE + """, aged AS (
  SELECT *, coalesce(year(month) * 12 + month(month) - year(available_month) * 12 - month(available_month) > 3, false) AS stale_report FROM matched)"""


@query(
    "stale_reports",
    _STALE
    + """SELECT entity, month, stale_report, CASE WHEN NOT stale_report THEN company END AS company,
  CASE WHEN NOT stale_report THEN available_month END AS available_month, CASE WHEN NOT stale_report THEN round(asset_turnover, 8) + 0.0 END AS asset_turnover,
  CASE WHEN NOT stale_report AND available_month IS NOT NULL THEN 1 ELSE 0 END AS has_compustat_annual FROM aged""",
)
def stale_reports(spark, sf):
    out = accounting.merge_reports(_grid(spark, sf), _available(spark, sf), max_age=3)
    cols = ["entity", "month", "stale_report", "company", "available_month", "asset_turnover", "has_compustat_annual"]
    return rounded(out.select(*cols), 8)


@query(
    "report_timing_check",
    _STALE
    + """SELECT 'available_in_the_future' AS "check", count(*) FILTER (available_month > month) AS failures, count(*) FILTER (available_month > month) = 0 AS ok FROM aged
  UNION ALL SELECT 'stale', count(*) FILTER (stale_report), count(*) FILTER (stale_report) = 0 FROM aged""",
)
def report_timing_check(spark, sf):
    out = accounting.merge_reports(_grid(spark, sf), _available(spark, sf), max_age=3)
    return quality.expect(
        out, [quality.never(F.col("available_month") > F.col("month"), "available_in_the_future"), quality.never(F.col("stale_report"), "stale")]
    )


# --- macro states ----------------------------------------------------------------
@query(
    "lagged_macro_join",
    with_views(PRICES, MACRO)
    + f"SELECT entity, p.month, {r('ret_1m m1 m2 m3 m4', 7)} FROM prices p LEFT JOIN macro x ON p.month = last_day(x.month + INTERVAL 1 DAY)",
)
def lagged_macro_join(spark, sf):
    m = src.monthly_prices(spark, sf).select("entity", "month", "ret_1m")
    return rounded(relational.join_lagged_period(m, src.macro(spark, sf), "month", "month"), 7)


@query(
    "lagged_macro_coverage",
    with_views(PRICES, MACRO)
    + """, j AS (SELECT p.month, m1, m2, m3, m4 FROM prices p LEFT JOIN macro x ON p.month = last_day(x.month + INTERVAL 1 DAY))
SELECT month, count(*) AS rows FROM j WHERE month > (SELECT min(month) FROM j) AND (m1 IS NULL OR m2 IS NULL OR m3 IS NULL OR m4 IS NULL) GROUP BY month""",
)
def lagged_macro_coverage(spark, sf):
    m = src.monthly_prices(spark, sf).select("entity", "month")
    joined = relational.join_lagged_period(m, src.macro(spark, sf), "month", "month")
    return islands.lagged_coverage(joined, "month", src.MACRO)


@query(
    "month_sequence_gaps",
    """WITH m AS (SELECT DISTINCT last_day(CAST(o_orderdate AS DATE)) AS month FROM orders WHERE month(o_orderdate) <> 5),
e AS (SELECT last_day(CAST(unnest(generate_series(date_trunc('month', min(month)), max(month), INTERVAL 1 MONTH)) AS DATE)) AS month FROM m)
SELECT month FROM e WHERE month NOT IN (SELECT month FROM m)""",
)
def month_sequence_gaps(spark, sf):
    orders = src.table(spark, sf, "orders").filter(F.month("o_orderdate") != 5)
    return islands.month_sequence_gaps(orders.select(month_end("o_orderdate").alias("month")).distinct(), "month")


# --- runs ------------------------------------------------------------------------
_HOURS = """WITH h AS (SELECT user_id, date_trunc('day', ts) AS day, CASE WHEN count(*) > 6 THEN NULL ELSE count(*) % 2 END AS v FROM events GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN coalesce(v <> lag(v) OVER w, true) THEN 1 ELSE 0 END AS new FROM h WINDOW w AS (PARTITION BY user_id ORDER BY day)),
k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY day) AS run FROM c),
runs AS (SELECT user_id, CAST(run AS BIGINT) AS run, max(v) AS value, CAST(min(day) AS DATE) AS start, CAST(max(day) AS DATE) AS "end", count(*) AS length FROM k GROUP BY user_id, run)"""


def _daily_parity(spark, sf):
    n = F.count(F.lit(1))
    return src.table(spark, sf, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.when(n <= 6, n % 2).alias("v"))


@query("value_runs", _HOURS + 'SELECT user_id, run, value, start, "end", length FROM runs')
def value_runs(spark, sf):
    return islands.value_runs(_daily_parity(spark, sf), ["user_id"], "day", "v")


@query(
    "longest_run",
    _HOURS
    + """SELECT user_id, value, start, "end", length FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length DESC, start) AS rn FROM runs) WHERE rn = 1""",
)
def longest_run(spark, sf):
    return islands.longest_run(_daily_parity(spark, sf), ["user_id"], "day", "v")


@query(
    "stale_constant_check",
    with_views(MACRO)
    + """, v AS (SELECT month, floor(m1 * 4) / 4 AS v FROM macro),
c AS (SELECT *, CASE WHEN coalesce(v <> lag(v) OVER (ORDER BY month), true) THEN 1 ELSE 0 END AS new FROM v),
k AS (SELECT *, sum(new) OVER (ORDER BY month) AS run FROM c),
runs AS (SELECT run, max(v) AS value, min(month) AS start, max(month) AS "end", count(*) AS length FROM k GROUP BY run)
SELECT value, start, "end", length, length > 12 AS stale FROM runs ORDER BY length DESC, start LIMIT 1""",
)
def stale_constant_check(spark, sf):
    m = src.macro(spark, sf).select("month", (F.floor(F.col("m1") * 4) / 4).alias("v"))
    out = islands.longest_run(m, [], "month", "v")
    return out.withColumn("stale", F.col("length") > names.MAX_CONSTANT_RUN)


# --- cross-sections ----------------------------------------------------------------
_FEATURES = ["ret_1m", "retvol_1m", "avg_log_dolvol_1m", "avg_range_1m"]
_CROSS = MONTHLY + """, cross_section AS (
  SELECT entity, month, ret_1m, retvol_1m, CASE WHEN entity % 7 <> 0 THEN avg_log_dolvol_1m END AS avg_log_dolvol_1m,
         CASE WHEN month(month) <> 2 THEN avg_range_1m END AS avg_range_1m
  FROM monthly)"""


def _cross_section(spark, sf):
    monthly = resample.resample_monthly(src.bars(spark, sf), "entity", "date")
    m = timeline.gap_aware_return(monthly, "entity", "month", "last_adj_close", "ret_1m")
    return m.select(
        "entity", "month", "ret_1m", "retvol_1m",
        F.when(F.col("entity") % 7 != 0, F.col("avg_log_dolvol_1m")).alias("avg_log_dolvol_1m"),
        F.when(F.month("month") != 2, F.col("avg_range_1m")).alias("avg_range_1m"),
    )


def _cross_sql(winsor: bool) -> str:
    filled = ", ".join(
        f"coalesce(c.{f}, median(c.{f}) OVER (PARTITION BY c.month), 0.0) AS {f}" for f in _FEATURES
    )
    out = f"{with_views(_CROSS)}, filled AS (SELECT entity, month, {filled} FROM cross_section c)"
    if not winsor:
        return out + f"SELECT entity, month, {r(' '.join(_FEATURES), 7)} FROM filled"
    bounds = ", ".join(f"quantile_cont({f}, 0.01) AS {f}_lo, quantile_cont({f}, 0.99) AS {f}_hi" for f in _FEATURES)
    clipped = ", ".join(f"round(greatest({f}_lo, least({f}_hi, {f})), 7) + 0.0 AS {f}" for f in _FEATURES)
    return out + f", b AS (SELECT month, {bounds} FROM filled GROUP BY month) SELECT entity, month, {clipped} FROM filled JOIN b USING (month)"


@query("median_impute", _cross_sql(False))
def median_impute(spark, sf):
    return rounded(crosssection.impute_and_winsorize(_cross_section(spark, sf), "month", _FEATURES, winsorize=False), 7)


@query("winsorize", _cross_sql(True))
def winsorize(spark, sf):
    return rounded(crosssection.impute_and_winsorize(_cross_section(spark, sf), "month", _FEATURES), 7)


@query(
    "group_quantiles",
    "SELECT l_returnflag, feature, count(v) AS n, count(*) AS total, round(quantile_cont(v, 0.01), 6) + 0.0 AS q0, round(quantile_cont(v, 0.5), 6) + 0.0 AS q1,"
    " round(quantile_cont(v, 0.99), 6) + 0.0 AS q2 FROM (SELECT l_returnflag, 'l_extendedprice' AS feature, l_extendedprice AS v FROM lineitem"
    " UNION ALL SELECT l_returnflag, 'l_quantity', nullif(l_quantity, 1) FROM lineitem) GROUP BY ALL",
)
def quantiles_by_group(spark, sf):
    line = src.table(spark, sf, "lineitem").select(
        "l_returnflag", "l_extendedprice", F.when(F.col("l_quantity") != 1, F.col("l_quantity")).alias("l_quantity")
    )
    return rounded(group_quantiles(line, ["l_returnflag"], ["l_extendedprice", "l_quantity"], [0.01, 0.5, 0.99]))


@query(
    "cross_section_broadcast",
    with_views(PRICES)
    + """SELECT entity, month, round(ret_1m, 8) + 0.0 AS ret_1m, round(avg(ret_1m) OVER w, 8) + 0.0 AS mean_ret, round(ret_1m - avg(ret_1m) OVER w, 8) + 0.0 AS excess,
  count(*) OVER w AS entities FROM prices WINDOW w AS (PARTITION BY month)""",
)
def cross_section_broadcast(spark, sf):
    m = src.monthly_prices(spark, sf).select("entity", "month", "ret_1m")
    stats = m.groupBy("month").agg(F.avg("ret_1m").alias("mean_ret"), F.count(F.lit(1)).alias("entities"))
    out = relational.join_period(m, stats, "month")
    return rounded(out.select("entity", "month", "ret_1m", "mean_ret", (F.col("ret_1m") - F.col("mean_ret")).alias("excess"), "entities"), 8)


@query(
    "fill_flags",
    "SELECT p_partkey, CAST(coalesce(CASE WHEN p_size % 3 <> 0 THEN CAST(p_size > 25 AS INT) END, 0) AS TINYINT) AS large FROM part",
)
def fill_flags(spark, sf):
    part = src.table(spark, sf, "part")
    flagged = part.select("p_partkey", F.when(F.col("p_size") % 3 != 0, (F.col("p_size") > 25).cast("int")).alias("large"))
    return crosssection.fill_flags(flagged, ["large"])


_CODE = "CASE WHEN c_nationkey % 6 = 5 THEN -1 ELSE c_nationkey // 5 END"


@query(
    "one_hot_codes",
    f"SELECT c_custkey, CAST(({_CODE}) = -1 AS TINYINT) AS code_missing, "
    + ", ".join(f"CAST(({_CODE}) = {v} AS TINYINT) AS code_{v}" for v in range(5))
    + " FROM customer",
)
def one_hot_codes(spark, sf):
    nation = F.col("c_nationkey")
    code = F.when(nation % 6 == 5, F.lit("n/a")).otherwise(F.floor(nation / 5).cast("string"))
    coded = src.table(spark, sf, "customer").select("c_custkey", code.alias("code"))
    out, labels = crosssection.one_hot(coded, "code", "code")
    return out.select("c_custkey", *labels)


@query(
    "interactions",
    with_views(PRICES, MACRO)
    + ", j AS (SELECT entity, p.month, ret_1m, last_adj_close / 99.7 AS level, m1, m2, m3, m4 FROM prices p LEFT JOIN macro x ON p.month = last_day(x.month + INTERVAL 1 DAY))"
    + " SELECT entity, month, "
    + ", ".join(f"round({c} * {m}, 8) + 0.0 AS {c}_x_{m}" for m in ("m1", "m2", "m3", "m4") for c in ("ret_1m", "level"))
    + " FROM j",
)
def interaction_columns(spark, sf):
    m = src.monthly_prices(spark, sf).select("entity", "month", "ret_1m", (F.col("last_adj_close") / 99.7).alias("level"))
    joined = relational.join_lagged_period(m, src.macro(spark, sf), "month", "month")
    out, made = crosssection.interactions(joined, ["ret_1m", "level"], src.MACRO)
    return rounded(out.select("entity", "month", *made), 8)


# --- contracts ----------------------------------------------------------------------
@query(
    "contract_checks",
    """WITH s AS (SELECT sum(c - 1) AS surplus FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)),
q AS (SELECT count(*) FILTER (l_quantity = 1) AS nulls, count(*) FILTER (l_discount = 0) AS infs, count(*) FILTER (l_tax > 0.07) AS tax FROM lineitem)
SELECT 'null_values' AS "check", nulls AS failures, nulls = 0 AS ok FROM q UNION ALL SELECT 'infinite_values', infs, infs = 0 FROM q
UNION ALL SELECT 'tax_too_high', tax, tax = 0 FROM q UNION ALL SELECT 'duplicate_keys', CAST(surplus AS BIGINT), surplus = 0 FROM s""",
)
def contract_checks(spark, sf):
    line = src.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_tax",
        F.when(F.col("l_quantity") != 1, F.col("l_quantity")).alias("q"),
        F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_discount")).alias("d"),
    )
    checks = [quality.no_nulls(["q"]), quality.no_infinities(["d"]), quality.never(F.col("l_tax") > 0.07, "tax_too_high")]
    return quality.expect(line, checks, unique=["l_orderkey", "l_linenumber"])


@query(
    "dummy_and_interaction_contract",
    with_views(PRICES, MACRO)
    + """, j AS (SELECT entity, ret_1m, m1, ret_1m * m1 AS x, CAST(entity % 4 = 0 AS INT) + CAST(entity % 4 = 1 AS INT) + CAST(entity % 4 = 2 AS INT)
  + CAST(entity % 4 = 3 AS INT) AS active FROM prices p LEFT JOIN macro s ON p.month = last_day(s.month + INTERVAL 1 DAY)),
c AS (SELECT count(*) FILTER (active <> 1) AS a, count(*) FILTER (x <> ret_1m * m1) AS b FROM j)
SELECT 'one_active_dummy' AS "check", a AS failures, a = 0 AS ok FROM c UNION ALL SELECT 'interaction_is_product', b, b = 0 FROM c""",
)
def dummy_and_interaction_contract(spark, sf):
    m = src.monthly_prices(spark, sf).withColumn("code", (F.col("entity") % 4).cast("string"))
    coded, labels = crosssection.one_hot(m, "code", "code")
    joined = relational.join_lagged_period(coded, src.macro(spark, sf), "month", "month")
    out, made = crosssection.interactions(joined, ["ret_1m"], ["m1"])
    active = sum(F.col(c).cast("int") for c in labels)
    checks = [
        quality.never(active != 1, "one_active_dummy"),
        quality.never(F.col(made[0]) != F.col("ret_1m") * F.col("m1"), "interaction_is_product"),
    ]
    return quality.expect(out, checks)


@query(
    "constant_columns",
    """WITH c AS (SELECT 'o_totalprice' AS "column", count(DISTINCT o_totalprice) AS n FROM orders UNION ALL SELECT 'one', count(DISTINCT 1) FROM orders
UNION ALL SELECT 'o_orderstatus_is_text', count(DISTINCT length(o_orderstatus) > 0) FROM orders) SELECT "column" FROM c WHERE n <= 1""",
)
def constant_columns(spark, sf):
    orders = src.table(spark, sf, "orders").select(
        F.col("o_totalprice"), F.lit(1).alias("one"), (F.length("o_orderstatus") > 0).cast("int").alias("o_orderstatus_is_text")
    )
    return quality.constant_columns(orders, orders.columns)


@query(
    "table_diff",
    """WITH a AS (SELECT o_custkey, sum(o_totalprice) AS s, avg(o_totalprice) AS m FROM orders GROUP BY 1),
b AS (SELECT o_custkey, sum(o_totalprice) + CASE WHEN o_custkey % 10 = 0 THEN 0.5 ELSE 0 END AS s, CASE WHEN o_custkey % 100 <> 11 THEN avg(o_totalprice) END AS m
  FROM orders WHERE o_custkey % 100 <> 7 GROUP BY 1),
j AS (SELECT a.s AS sa, b.s AS sb, a.m AS ma, b.m AS mb, a.o_custkey IS NULL OR b.o_custkey IS NULL AS lost FROM a FULL JOIN b ON a.o_custkey = b.o_custkey),
d AS (SELECT 's' AS "column", max(abs(sa - sb)) AS diff, count(*) FILTER (NOT lost AND (sa IS NULL) <> (sb IS NULL)) AS null_mismatches, count(*) FILTER (lost) AS unmatched_keys FROM j
  UNION ALL SELECT 'm', max(abs(ma - mb)), count(*) FILTER (NOT lost AND (ma IS NULL) <> (mb IS NULL)), count(*) FILTER (lost) FROM j)
SELECT "column", round(coalesce(diff, 0), 4) + 0.0 AS max_abs_diff, null_mismatches, unmatched_keys, coalesce(diff, 0) <= 1e-6 AND null_mismatches = 0 AND unmatched_keys = 0 AS ok FROM d""",
)
def table_difference(spark, sf):
    orders = src.table(spark, sf, "orders")
    a = orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"), F.avg("o_totalprice").alias("m"))
    bump = F.when(F.col("o_custkey") % 10 == 0, 0.5).otherwise(0.0)
    b = a.filter(F.col("o_custkey") % 100 != 7).withColumn("s", F.col("s") + bump).withColumn("m", F.when(F.col("o_custkey") % 100 != 11, F.col("m")))
    return rounded(quality.table_diff(a, b, ["o_custkey"], ["s", "m"], 1e-6), 4)


# --- the assembled panel ----------------------------------------------------------------
def _panel(spark, sf):
    market = src.market(spark, sf)
    bars = src.bars(spark, sf).withColumn("entity", F.concat(F.lit("S"), F.col("entity")))
    return panel.monthly_panel(bars, market, market, src.rates(spark, sf))


_PANEL_COLUMNS = ["ret_1m", "mom6m", "retvol12m", "price_to_ma12", "beta_12m", "idiovol_12m", "market_ret_1m", "vix_avg_1m", names.TARGET]
_FRAME_12 = "OVER (PARTITION BY entity ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"
_FRAME_6 = "OVER (PARTITION BY entity ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)"
_FRAME_252 = "OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
_PANEL_SQL = f"""{MONTHLY}, {MARKET}, {RATES}, holes AS (
  SELECT entity, year(month) * 12 + month(month) - lag(year(month) * 12 + month(month)) OVER (PARTITION BY entity ORDER BY month) - 1 AS hole FROM monthly),
kept AS (SELECT * FROM monthly WHERE entity NOT IN (SELECT entity FROM holes GROUP BY entity HAVING max(hole) > 2)),
market_daily AS (SELECT *, last_day(date) AS month, adj_close / lag(adj_close) OVER (ORDER BY date) - 1 AS mret FROM market),
market_months AS (SELECT month, arg_max(adj_close, date) AS p, avg(level) AS vix_avg_1m FROM market_daily GROUP BY month),
market_gap AS (SELECT *, lag(month) OVER (ORDER BY month) AS before, lag(p) OVER (ORDER BY month) AS pb FROM market_months),
market_state AS (SELECT month, vix_avg_1m, CASE WHEN month = last_day(before + INTERVAL 1 DAY) THEN p / pb - 1 END AS market_ret_1m FROM market_gap),
pairs AS (SELECT entity, date, ret, mret FROM daily JOIN market_daily USING (date) WHERE ret IS NOT NULL AND mret IS NOT NULL),
pair_moments AS (SELECT entity, date, CASE WHEN count(*) {_FRAME_252} >= 126 THEN covar_samp(ret, mret) {_FRAME_252} END AS cov, var_samp(mret) {_FRAME_252} AS vm,
  var_samp(ret) {_FRAME_252} AS vs FROM pairs),
risk_days AS (SELECT entity, date, last_day(date) AS month, cov / nullif(vm, 0) AS beta, CASE WHEN cov IS NOT NULL THEN sqrt(greatest(vs - (cov / nullif(vm, 0)) ** 2 * vm, 0)) END AS idio FROM pair_moments),
risk AS (SELECT entity, month, arg_max(beta, date) AS beta_12m, arg_max(idio, date) AS idiovol_12m FROM risk_days GROUP BY entity, month),
features AS (
  SELECT *, CASE WHEN count(ret_1m) {_FRAME_6} = 6 THEN product(1 + ret_1m) {_FRAME_6} - 1 END AS mom6m, CASE WHEN count(retvol_1m) {_FRAME_12} = 12 THEN avg(retvol_1m) {_FRAME_12} END AS retvol12m,
    CASE WHEN count(last_adj_close) {_FRAME_12} = 12 THEN last_adj_close / avg(last_adj_close) {_FRAME_12} END AS price_to_ma12,
    CASE WHEN lead(month) OVER w = last_day(month + INTERVAL 1 DAY) THEN lead(ret_1m) OVER w END AS ret_next
  FROM kept WINDOW w AS (PARTITION BY entity ORDER BY month)),
panel AS (
  SELECT f.*, beta_12m, idiovol_12m, market_ret_1m, vix_avg_1m, ret_next - rate AS {names.TARGET}
  FROM features f LEFT JOIN risk USING (entity, month) LEFT JOIN market_state USING (month)
  LEFT JOIN rates ON rates.month = last_day(f.month + INTERVAL 1 DAY) WHERE ret_next - rate IS NOT NULL)"""


@query("monthly_panel", with_views(_PANEL_SQL) + f"SELECT 'S' || entity AS entity, month, {r(' '.join(_PANEL_COLUMNS), 7)} FROM panel")
def monthly_panel(spark, sf):
    return rounded(_panel(spark, sf).select("entity", "month", *_PANEL_COLUMNS), 7)


def _dataset(spark, sf):
    full = panel.add_reports(_panel(spark, sf), src.annual(spark, sf))
    base, predictors = panel.base_dataset(full, src.macro(spark, sf), src.MACRO)
    return panel.model_dataset(base, predictors, src.MACRO, is_stored=True)  # a projection of the stored panel


@query("model_dataset")
def model_dataset(spark, sf):
    """The whole table: keys, target and all predictors."""
    return _dataset(spark, sf)[0]


_CLEANED = ["mom6m", "price_to_ma12", "asset_turnover", "sales_growth"]
_DATASET_SQL = (
    with_views(_PANEL_SQL, ANNUAL, MACRO)
    + _GROWTH.format(source="annual")
    + f""", reports AS (SELECT entity, last_day(datadate + INTERVAL 6 MONTH) AS available_month, sale / nullif(assets, 0) AS asset_turnover, sales_growth,
  CASE WHEN coalesce(dvt, 0) > 0 THEN 1 ELSE 0 END AS dividend_dummy, CAST(floor(sic / 100) AS INT) AS sic2 FROM growth),
joined AS (SELECT p.month, p.mom6m, p.price_to_ma12, p.{names.TARGET}, 'S' || p.entity AS entity, x.available_month, x.asset_turnover, x.sales_growth, x.dividend_dummy, x.sic2
  FROM panel p ASOF LEFT JOIN reports x ON 'S' || p.entity = x.entity AND p.month >= x.available_month),
fresh AS (SELECT *, available_month IS NOT NULL AND year(month) * 12 + month(month) - year(available_month) * 12 - month(available_month) <= 12 AS ok FROM joined
  WHERE month > (SELECT min(month) FROM joined)),
filled AS (SELECT entity, month, {names.TARGET}, CASE WHEN ok THEN dividend_dummy ELSE 0 END AS dividend_dummy, CASE WHEN ok THEN 1 ELSE 0 END AS has_compustat_annual,
  CASE WHEN ok AND sic2 = 3 THEN 1 ELSE 0 END AS sic2_3, CASE WHEN ok THEN 0 ELSE 1 END AS sic2_missing, """
    + ", ".join(
        f"coalesce({v}, median({v}) OVER (PARTITION BY month), 0.0) AS {c}"
        for c, v in [("mom6m", "mom6m"), ("price_to_ma12", "price_to_ma12"), ("asset_turnover", "CASE WHEN ok THEN asset_turnover END"), ("sales_growth", "CASE WHEN ok THEN sales_growth END")]
    )
    + " FROM fresh), bounds AS (SELECT month, "
    + ", ".join(f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi" for c in _CLEANED)
    + f" FROM filled GROUP BY month), clipped AS (SELECT f.entity, f.month, {names.TARGET}, dividend_dummy, has_compustat_annual, sic2_3, sic2_missing, "
    + ", ".join(f"greatest({c}_lo, least({c}_hi, {c})) AS {c}" for c in _CLEANED)
    + " FROM filled f JOIN bounds USING (month))"
    + f" SELECT entity, c.month, {r(names.TARGET + ' ' + ' '.join(_CLEANED) + ' m1', 7)}, CAST(dividend_dummy AS TINYINT) AS dividend_dummy,"
    + " CAST(has_compustat_annual AS TINYINT) AS has_compustat_annual, CAST(sic2_3 AS TINYINT) AS sic2_3, CAST(sic2_missing AS TINYINT) AS sic2_missing,"
    + " round(sales_growth * m2, 7) + 0.0 AS sales_growth_x_m2 FROM clipped c LEFT JOIN macro x ON c.month = last_day(x.month + INTERVAL 1 DAY)"
)


@query("model_dataset_columns", _DATASET_SQL)
def model_dataset_columns(spark, sf):
    """Columns of every kind from the model dataset, for comparison."""
    cols = [names.TARGET, *_CLEANED, "m1", "dividend_dummy", "has_compustat_annual", "sic2_3", "sic2_missing", "sales_growth_x_m2"]
    return rounded(_dataset(spark, sf)[0].select("entity", "month", *cols), 7)


@query(
    "model_dataset_contract",
    """SELECT unnest(['null_values', 'infinite_values', 'duplicate_keys']) AS "check", unnest([0, 0, 0]) AS failures, true AS ok""",
)
def model_dataset_contract(spark, sf):
    """Final checks: no NULL, no infinity, no repeated key."""
    dataset, contract = _dataset(spark, sf)
    return panel.dataset_checks(dataset, contract, strict=False)


@query("model_dataset_summary")
def model_dataset_summary(spark, sf):
    return panel.dataset_summary(*_dataset(spark, sf))


@query(
    "macro_checks",
    with_views(MACRO)
    + """, v AS (SELECT month, m1, floor(m1 * 4) / 4 AS v FROM macro WHERE month <> DATE '1997-04-30'),
e AS (SELECT last_day(CAST(unnest(generate_series(date_trunc('month', min(month)), max(month), INTERVAL 1 MONTH)) AS DATE)) AS month FROM v),
c AS (SELECT *, CASE WHEN coalesce(v <> lag(v) OVER (ORDER BY month), true) THEN 1 ELSE 0 END AS new FROM v),
k AS (SELECT *, sum(new) OVER (ORDER BY month) AS run FROM c), runs AS (SELECT count(*) AS n FROM k GROUP BY run)
SELECT 'null_values' AS "check", count(*) FILTER (m1 IS NULL) AS failures, count(*) FILTER (m1 IS NULL) = 0 AS ok FROM v
UNION ALL SELECT 'duplicate_keys', count(*) - count(DISTINCT month), count(*) = count(DISTINCT month) FROM v
UNION ALL SELECT 'missing_months', count(*), count(*) = 0 FROM e WHERE month NOT IN (SELECT month FROM v)
UNION ALL SELECT 'stale_v', CASE WHEN max(n) > 12 THEN max(n) ELSE 0 END, max(n) <= 12 FROM runs""",
)
def macro_checks(spark, sf):
    """A series with one month taken out and one coarse (hence possibly stale) column."""
    m = src.macro(spark, sf).filter(F.col("month") != F.lit("1997-04-30").cast("date"))
    return panel.macro_problems(m.select("month", "m1", (F.floor(F.col("m1") * 4) / 4).alias("v")), ["m1"], ["v"])


# --- scalar functions on whole columns ------------------------------------------------------
@query(
    "date_functions",
    """SELECT o_orderkey, last_day(CAST(o_orderdate AS DATE)) AS month, last_day(last_day(CAST(o_orderdate AS DATE)) + INTERVAL 1 DAY) AS following,
  last_day(CAST(o_orderdate AS DATE) + INTERVAL 6 MONTH) AS available, year(o_orderdate) * 12 + month(o_orderdate) AS number,
  datediff('day', CAST(o_orderdate AS DATE), DATE '1999-06-30') BETWEEN 300 AND 430 AS spaced,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE last_day(CAST(o_orderdate AS DATE)) END AS parsed FROM orders""",
)
def date_functions(spark, sf):
    day = F.col("o_orderdate").cast("date")
    code = F.when(F.col("o_orderkey") % 13 == 0, F.lit("199913")).otherwise(F.date_format(day, "yyyyMM"))
    return src.table(spark, sf, "orders").select(
        "o_orderkey",
        month_end("o_orderdate").alias("month"),
        shift_month_end(month_end("o_orderdate"), 1).alias("following"),
        shift_month_end(day, 6).alias("available"),
        month_number(day).cast("long").alias("number"),
        days_apart_between(F.lit("1999-06-30").cast("date"), day, 300, 430).alias("spaced"),
        parse_yyyymm(code).alias("parsed"),
    )


@query(
    "numeric_functions",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 2) + 0.0 AS l_extendedprice, round(ln(1 + l_extendedprice), 8) + 0.0 AS log1p_price,
  round(CASE WHEN l_discount > 0 THEN ln(l_discount) END, 8) + 0.0 AS log_discount, round(sqrt(greatest(l_tax - 0.02, 0)), 8) + 0.0 AS root,
  round(l_quantity / nullif(l_discount, 0), 6) + 0.0 AS ratio, round(greatest(5.0, least(45.0, l_quantity)), 6) + 0.0 AS clipped,
  round(CASE WHEN l_quantity > 25 THEN l_quantity END, 6) + 0.0 AS masked, round(coalesce(nullif(l_tax, 0), nullif(l_discount, 0), -1), 6) + 0.0 AS chain,
  l_returnflag || '_' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') AS id FROM lineitem""",
)
def numeric_functions(spark, sf):
    c = F.col
    out = src.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        F.log1p("l_extendedprice").alias("log1p_price"),
        positive_log("l_discount").alias("log_discount"),
        sqrt_nonnegative(c("l_tax") - 0.02).alias("root"),
        safe_ratio("l_quantity", "l_discount").alias("ratio"),
        clip("l_quantity", F.lit(5.0), F.lit(45.0)).alias("clipped"),
        F.when(c("l_quantity") > 25, c("l_quantity")).alias("masked"),
        first_present(F.nullif(c("l_tax"), F.lit(0.0)), F.nullif(c("l_discount"), F.lit(0.0)), F.lit(-1.0)).alias("chain"),
        numbered_id("l_returnflag", "l_linenumber").alias("id"),
    )
    return rounded(out, 6, log1p_price=8, log_discount=8, root=8, l_extendedprice=2)
