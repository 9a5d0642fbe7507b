"""Queries on forecasts: metrics, summaries, folds, selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelmill.functions import names
from panelmill.models.grid import grid_problems
from panelmill.operators import evaluate, folds, quality, relational
from panelmill.plans.registry import query, r, rounded, with_views
from panelmill.plans.views_sql import METRIC_COLUMNS, PREDICTIONS, PRICES, YEARLY, metrics
from panelmill.session import cut_lineage
from panelmill.sources import adapters as src
from panelmill.sources.readers import load_checked

_M = METRIC_COLUMNS
_P = with_views(PREDICTIONS)


@query(
    "monthly_mse",
    _P + """SELECT model, sample, round(avg(mse), 10) + 0.0 AS monthly_mse FROM (SELECT model, sample, month, avg((realized_target - prediction) ** 2) AS mse FROM predictions
GROUP BY model, sample, month) GROUP BY model, sample""",
)
def monthly_mse(spark, sf):
    out = evaluate.monthly_mse(src.panel_predictions(spark, sf), ["model", "sample"], "month", "realized_target", "prediction")
    return rounded(out, 10)


@query(
    "metrics_by_model",
    with_views(PREDICTIONS + metrics("predictions", "model, sample", "bundle")) + f"SELECT model, sample, observations, months, {r(_M, 8)} FROM bundle",
)
def metrics_by_model(spark, sf):
    return rounded(evaluate.forecast_metrics(src.panel_predictions(spark, sf), ["model", "sample"]), 8)


@query(
    "metrics_by_model_and_year",
    with_views(
        PREDICTIONS + ", dated AS (SELECT *, year(month) AS year FROM predictions WHERE sample = 'validation')" + metrics("dated", "model, year", "bundle")
    )
    + f"SELECT model, year, observations, months, {r(_M, 8)} FROM bundle",
)
def metrics_by_model_and_year(spark, sf):
    p = src.panel_predictions(spark, sf).filter(F.col("sample") == "validation").withColumn("year", F.year("month").cast("long"))
    return rounded(evaluate.forecast_metrics(p, ["model", "year"]), 8)


def _yearly(spark, sf):
    return evaluate.yearly_metrics(src.panel_predictions(spark, sf).drop("benchmark"))


def interpretation(spark, sf):
    """Model summary over all predictions, which are stored once because three tables are made from them."""
    p = cut_lineage(src.panel_predictions(spark, sf).withColumn("sample", F.lit("all")))
    whole = evaluate.forecast_metrics(p, ["model", "sample"])
    return evaluate.model_interpretation(whole, p, evaluate.yearly_metrics(p.drop("benchmark")), "all")


@query("yearly_metrics", with_views(YEARLY) + f"SELECT model, year, observations, months, {r(_M, 8)} FROM yearly")
def yearly_metrics(spark, sf):
    return rounded(_yearly(spark, sf), 8)


@query(
    "benchmark_attach",
    _P + """SELECT model, entity, month, round(prediction, 8) + 0.0 AS prediction,
  round(max(CASE WHEN model = 'lag' THEN prediction END) OVER (PARTITION BY entity, month), 8) + 0.0 AS benchmark FROM predictions""",
)
def benchmark_attach(spark, sf):
    p = src.panel_predictions(spark, sf).select("model", "entity", "month", "prediction")
    return rounded(relational.attach_benchmark(p, "lag", ["entity", "month"]), 8)


_STABILITY = """, stability AS (
  SELECT model, avg(monthly_mse) AS yearly_mean_mse, stddev_samp(monthly_mse) AS yearly_mse_std, avg(monthly_oos_r2) AS yearly_mean_monthly_oos_r2,
         stddev_samp(monthly_oos_r2) AS yearly_monthly_oos_r2_std, avg(oos_r2) AS yearly_mean_pooled_oos_r2,
         avg(CASE WHEN monthly_oos_r2 > 1e-6 THEN 1.0 ELSE 0.0 END) AS positive_monthly_oos_r2_year_share, count(year) AS number_of_years_evaluated
  FROM yearly GROUP BY model)"""
_S = "yearly_mean_mse yearly_mse_std yearly_mean_monthly_oos_r2 yearly_monthly_oos_r2_std yearly_mean_pooled_oos_r2 positive_monthly_oos_r2_year_share"


@query("yearly_stability", with_views(YEARLY + _STABILITY) + f"SELECT model, {r(_S, 8)}, number_of_years_evaluated FROM stability")
def yearly_stability(spark, sf):
    return rounded(evaluate.yearly_stability(_yearly(spark, sf)), 8)


@query(
    "best_and_worst_year",
    with_views(YEARLY)
    + """, b AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY monthly_mse, year) AS best, row_number() OVER (PARTITION BY model ORDER BY monthly_mse DESC, year) AS worst FROM yearly)
SELECT x.model, x.year AS best_test_year, round(x.monthly_mse, 8) + 0.0 AS best_test_year_mse, round(x.monthly_oos_r2, 8) + 0.0 AS best_test_year_monthly_oos_r2,
  round(x.oos_r2, 8) + 0.0 AS best_test_year_pooled_oos_r2, y.year AS worst_test_year, round(y.monthly_mse, 8) + 0.0 AS worst_test_year_mse,
  round(y.monthly_oos_r2, 8) + 0.0 AS worst_test_year_monthly_oos_r2, round(y.oos_r2, 8) + 0.0 AS worst_test_year_pooled_oos_r2
FROM b x JOIN b y ON x.model = y.model WHERE x.best = 1 AND y.worst = 1""",
)
def best_and_worst_year(spark, sf):
    return rounded(evaluate.best_and_worst_year(_yearly(spark, sf)), 8)


@query(
    "rank_models",
    with_views(PREDICTIONS + metrics("predictions", "model, sample", "bundle"))
    + f"""SELECT row_number() OVER (ORDER BY monthly_mse, pooled_rmse, pooled_mae) AS rank, model, sample, observations, {r('monthly_mse pooled_rmse pooled_mae', 8)}
FROM bundle WHERE sample = 'test'""",
)
def rank_models(spark, sf):
    m = evaluate.forecast_metrics(src.panel_predictions(spark, sf), ["model", "sample"])
    out = evaluate.rank_models(m, "test")
    return rounded(out.select(F.col("rank").cast("long").alias("rank"), "model", "sample", "observations", "monthly_mse", "pooled_rmse", "pooled_mae"), 8)


def _distribution_sql(value: str, distinct: str) -> str:
    return f"""count(*) AS observations, round(avg({value}), 8) + 0.0 AS mean, round(stddev_samp({value}), 8) + 0.0 AS std, round(min({value}), 8) + 0.0 AS minimum,
  round(quantile_cont({value}, 0.01), 8) + 0.0 AS p01, round(quantile_cont({value}, 0.5), 8) + 0.0 AS median, round(quantile_cont({value}, 0.99), 8) + 0.0 AS p99,
  round(max({value}), 8) + 0.0 AS maximum, {distinct}"""


@query(
    "target_summary",
    _P + "SELECT sample, " + _distribution_sql("realized_target", "count(DISTINCT month) AS months, count(DISTINCT entity) AS entities")
    + " FROM predictions WHERE model = 'lag' GROUP BY sample",
)
def target_summary(spark, sf):
    p = src.panel_predictions(spark, sf).filter(F.col("model") == "lag")
    return rounded(evaluate.distribution_summary(p, ["sample"], "realized_target", {"months": "month", "entities": "entity"}), 8)


@query(
    "prediction_summary",
    _P + "SELECT model, sample, " + _distribution_sql("prediction", "count(DISTINCT round(prediction, 7)) AS unique_predictions")
    + " FROM predictions GROUP BY model, sample",
)
def prediction_summary(spark, sf):
    # Scaled before it is rounded, as the SQL does: rounding the decimal text takes -0.00869565, a tie in writing only, to another side.
    p = src.panel_predictions(spark, sf).withColumn("r7", F.round(F.col("prediction") * 1e7))
    return rounded(evaluate.distribution_summary(p, ["model", "sample"], "prediction", {"unique_predictions": "r7"}), 8)


@query(
    "extreme_predictions",
    _P + """SELECT model, sample, entity, month, rank, round(prediction, 9) + 0.0 AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY model, sample
ORDER BY round(abs(prediction), 9) DESC, entity, month) AS rank FROM predictions WHERE model <> 'historical_mean') WHERE rank <= 25""",
)
def extreme_predictions(spark, sf):
    p = src.panel_predictions(spark, sf).filter(F.col("model") != names.BENCHMARK_MODEL).withColumn("prediction", F.round("prediction", 9))
    out = evaluate.extreme_predictions(p, ["model", "sample"], ["entity", "month"])
    return rounded(out.select("model", "sample", "entity", "month", F.col("rank").cast("long").alias("rank"), "prediction"), 9)


@query(
    "realised_and_bias",
    _P + """SELECT model, round(avg(realized_target), 8) + 0.0 AS realized_mean, round(stddev_samp(realized_target), 8) + 0.0 AS realized_std,
  round(avg(prediction) - avg(realized_target), 8) + 0.0 AS prediction_bias FROM predictions GROUP BY model""",
)
def realised_and_bias(spark, sf):
    out = interpretation(spark, sf)
    return rounded(out.select("model", "realized_mean", "realized_std", "prediction_bias"), 8)


@query(
    "historical_mean",
    with_views(PRICES)
    + """SELECT entity, month, round(ret_1m, 8) + 0.0 AS ret_1m, round((SELECT avg(ret_1m) FROM prices WHERE month <= DATE '1999-12-31'), 9) + 0.0 AS benchmark
FROM prices WHERE month > DATE '1999-12-31'""",
)
def historical_mean(spark, sf):
    m = src.monthly_prices(spark, sf).select("entity", "month", "ret_1m")
    s = relational.split_by_time(m, "month", "1997-12-31", "1999-12-31")
    return rounded(evaluate.historical_mean_benchmark(s["test"], s["development"], "ret_1m"), 8, benchmark=9)


@query(
    "behaviour_flags",
    with_views(YEARLY + _STABILITY + ", whole AS (SELECT *, 'all' AS part FROM predictions)" + metrics("whole", "model, part", "bundle"))
    + """, ranked AS (SELECT *, row_number() OVER (ORDER BY monthly_mse, pooled_rmse, pooled_mae) AS rank FROM bundle)
SELECT model, monthly_mse < (SELECT monthly_mse FROM ranked WHERE model = 'historical_mean') AS beats_historical_mean, monthly_oos_r2 > 1e-6 AS positive_monthly_oos_r2,
  oos_r2 > 1e-6 AS positive_pooled_oos_r2, prediction_std <= 1e-8 AS constant_or_near_constant_predictions, positive_monthly_oos_r2_year_share >= 0.5 AS positive_in_most_test_years,
  rank = 1 AS best_prediction_model, rank = (SELECT max(rank) FROM ranked) AS worst_prediction_model, CAST(1e-8 AS DOUBLE) AS near_constant_std_threshold,
  CAST(1e-6 AS DOUBLE) AS oos_r2_tolerance, CAST(0.5 AS DOUBLE) AS positive_year_share_threshold FROM ranked JOIN stability USING (model)""",
)
def behaviour_flags(spark, sf):
    return evaluate.behaviour_flags(interpretation(spark, sf))


@query(
    "prediction_contract",
    _P + """SELECT 'null_values' AS "check", count(*) FILTER (prediction IS NULL) AS failures, count(*) FILTER (prediction IS NULL) = 0 AS ok FROM predictions
UNION ALL SELECT 'infinite_values', count(*) FILTER (abs(prediction) = 'inf'::DOUBLE), count(*) FILTER (abs(prediction) = 'inf'::DOUBLE) = 0 FROM predictions
UNION ALL SELECT 'test_rows', count(*) FILTER (sample = 'test'), count(*) FILTER (sample = 'test') = 0 FROM predictions
UNION ALL SELECT 'duplicate_keys', count(*) - count(DISTINCT (model, sample, entity, month)), count(*) = count(DISTINCT (model, sample, entity, month)) FROM predictions""",
)
def prediction_contract(spark, sf):
    """Completeness and isolation checks on saved forecasts (test rows count as failures in a tuning input)."""
    p = src.panel_predictions(spark, sf)
    checks = [quality.no_nulls(["prediction"]), quality.no_infinities(["prediction"]), quality.never(F.col("sample") == "test", "test_rows")]
    return quality.expect(p, checks, unique=["model", "sample", "entity", "month"])


@query(
    "guarded_load",
    _P + "SELECT model, sample, entity, month, round(prediction, 8) + 0.0 AS prediction FROM predictions WHERE model IN ('lag', 'half_lag')",
)
def guarded_load(spark, sf):
    keys = ["model", "sample", "entity", "month"]
    out = load_checked(src.panel_predictions(spark, sf), [*keys, "prediction"], keys, "model", ["lag", "half_lag"], "predictions")
    return rounded(out.select(*keys, "prediction"), 8)


# --- folds and selection --------------------------------------------------------------------
_YEARS = [1998, 1999, 2000, 2001]
_FOLD_SQL = "f AS (SELECT fold_number, validation_year FROM (VALUES (1, 1998), (2, 1999), (3, 2000), (4, 2001)) AS t(fold_number, validation_year))"


@query(
    "expand_folds",
    f"WITH {_FOLD_SQL}"
    + """ SELECT fold_number, validation_year, CASE WHEN year(o_orderdate) = validation_year THEN 'validation' ELSE 'train' END AS role, count(*) AS rows,
  round(sum(o_totalprice), 1) + 0.0 AS total FROM orders JOIN f ON year(o_orderdate) <= validation_year GROUP BY ALL""",
)
def expand_folds(spark, sf):
    orders = src.table(spark, sf, "orders").select("o_orderdate", "o_totalprice")
    rows = folds.expand_folds(orders, folds.fold_table(spark, _YEARS), "o_orderdate")
    return rounded(rows.groupBy("fold_number", "validation_year", "role").agg(F.count(F.lit(1)).alias("rows"), F.sum("o_totalprice").alias("total")), 1)


@query(
    "fold_bounds",
    """WITH y AS (SELECT DISTINCT year(o_orderdate) AS v FROM orders WHERE year(o_orderdate) >= 1998), f AS (SELECT row_number() OVER (ORDER BY v) AS fold_number, v FROM y),
o AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT fold_number, v AS validation_year, min(d) FILTER (year(d) < v) AS train_start, max(d) FILTER (year(d) < v) AS train_end, min(d) FILTER (year(d) = v) AS validation_start,
  max(d) FILTER (year(d) = v) AS validation_end, count(*) FILTER (year(d) < v) AS train_observations, count(*) FILTER (year(d) = v) AS validation_observations
FROM f JOIN o ON year(d) <= v GROUP BY fold_number, v""",
)
def fold_bounds(spark, sf):
    d = src.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    return folds.fold_bounds(d, folds.validation_years(d, "d", 1998), "d")


@query(
    "fold_leakage",
    """WITH c AS (SELECT max(year(o_orderdate)) AS y FROM orders) SELECT 5 AS fold_number, y + 1 AS validation_year, false AS leaks, true AS empty FROM c""",
)
def fold_leakage(spark, sf):
    """Folds over the years of the data plus one year without data, which must be reported as empty."""
    d = src.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    known = folds.validation_years(d, "d", 1998)
    after = d.agg((F.max(F.year("d")) + 1).alias("validation_year")).select(F.lit(5).alias("fold_number"), "validation_year")
    out = folds.fold_problems(folds.fold_bounds(d, known.unionByName(after), "d"))
    return out.select("fold_number", F.col("validation_year").cast("long").alias("validation_year"), "leaks", "empty")


# Candidates: shrink the lagged return by a factor, in two families.
_FACTORS = [("lag", 1, 0.0), ("lag", 2, 0.05), ("lag", 3, 0.1), ("lag", 4, 0.5), ("mean", 1, 0.02), ("mean", 2, 0.9)]
_SCORES = PRICES + """, base AS (SELECT * FROM (SELECT entity, month, ret_1m AS y, lag(ret_1m) OVER (PARTITION BY entity ORDER BY month) AS x FROM prices)
  WHERE y IS NOT NULL AND x IS NOT NULL AND year(month) >= 1998),
grid AS (SELECT * FROM (VALUES """ + ", ".join(f"('{f}', '{f}_{k:03d}', CAST({v} AS DOUBLE), {str(k == 1).lower()})" for f, k, v in _FACTORS) + """) AS t(model_family, candidate_id, factor, is_fixed)),
monthly_scores AS (SELECT model_family, candidate_id, factor, is_fixed, month, avg((y - factor * x) ** 2) AS mse FROM base, grid GROUP BY ALL),
scores AS (SELECT model_family, candidate_id, factor, is_fixed, year(month) AS validation_year, avg(mse) AS monthly_mse FROM monthly_scores GROUP BY ALL),
summary AS (SELECT model_family, candidate_id, is_fixed, avg(monthly_mse) AS average_monthly_mse, stddev_samp(monthly_mse) AS fold_mse_std,
  stddev_samp(monthly_mse) / sqrt(count(*)) AS fold_mse_se, count(*) AS completed_folds FROM scores GROUP BY ALL)"""


def _scores(spark, sf):
    """Fold scores of the shrinkage candidates: the grid meets each row once, and months are reduced at once."""
    w = Window.partitionBy("entity").orderBy("month")
    m = src.monthly_prices(spark, sf)
    base = m.select("month", F.col("ret_1m").alias("y"), F.lag("ret_1m").over(w).alias("x")).dropna().filter(F.year("month") >= 1998)
    grid = F.array(
        *[
            F.struct(
                F.lit(f).alias("model_family"), F.lit(f"{f}_{k:03d}").alias("candidate_id"), F.lit(v).alias("factor"),
                F.lit(k == 1).alias("is_original_fixed_configuration"),
            )
            for f, k, v in _FACTORS
        ]
    )
    rows = base.select("month", "y", "x", F.inline(grid))
    p = rows.select("model_family", "candidate_id", "is_original_fixed_configuration", "month", "y", (F.col("factor") * F.col("x")).alias("p"))
    p = p.withColumn("validation_year", F.year("month").cast("long"))
    keys = ["model_family", "candidate_id", "is_original_fixed_configuration", "validation_year"]
    return evaluate.monthly_mse(p, keys, "month", "y", "p")


_KEYS = ["model_family", "candidate_id", "is_original_fixed_configuration"]
_SUM = "average_monthly_mse fold_mse_std fold_mse_se"


@query("fold_summary", with_views(_SCORES) + f"SELECT model_family, candidate_id, is_fixed AS is_original_fixed_configuration, {r(_SUM, 9)}, completed_folds FROM summary")
def fold_summary(spark, sf):
    return rounded(folds.summarise_folds(_scores(spark, sf), _KEYS), 9)


@query(
    "select_minimum",
    with_views(_SCORES) + """SELECT model_family, arg_min(candidate_id, average_monthly_mse) AS candidate_id, round(min(average_monthly_mse), 9) + 0.0 AS average_monthly_mse FROM summary GROUP BY 1""",
)
def select_minimum(spark, sf):
    out = folds.select_minimum(folds.summarise_folds(_scores(spark, sf), _KEYS))
    return rounded(out.select("model_family", "candidate_id", "average_monthly_mse"), 9)


@query(
    "rank_within_family",
    with_views(_SCORES)
    + """SELECT model_family, candidate_id, row_number() OVER (PARTITION BY model_family ORDER BY average_monthly_mse, candidate_id) AS within_family_rank,
  row_number() OVER (PARTITION BY model_family ORDER BY average_monthly_mse, candidate_id) = 1 AS selected FROM summary""",
)
def rank_within_family(spark, sf):
    out = folds.rank_within_family(folds.summarise_folds(_scores(spark, sf), _KEYS))
    return out.select("model_family", "candidate_id", F.col("within_family_rank").cast("long").alias("within_family_rank"), "selected")


@query(
    "fixed_vs_selected",
    with_views(_SCORES)
    + """, f AS (SELECT model_family, candidate_id AS fixed_candidate, average_monthly_mse AS a FROM summary WHERE is_fixed),
s AS (SELECT model_family, arg_min(candidate_id, average_monthly_mse) AS selected_candidate, min(average_monthly_mse) AS b FROM summary GROUP BY 1)
SELECT model_family, fixed_candidate, round(a, 9) + 0.0 AS fixed_average_monthly_mse, selected_candidate, round(b, 9) + 0.0 AS selected_average_monthly_mse,
  fixed_candidate = selected_candidate AS selected_is_original_fixed, round(a - b, 9) + 0.0 AS mse_improvement_over_fixed, 'descriptive_only' AS comparison_role FROM f JOIN s USING (model_family)""",
)
def fixed_vs_selected(spark, sf):
    return rounded(folds.fixed_vs_selected(folds.summarise_folds(_scores(spark, sf), _KEYS)), 9)


@query(
    "fold_coverage",
    with_views(_SCORES)
    + """SELECT candidate_id, count(validation_year) AS folds, count(DISTINCT validation_year) AS distinct_folds, min(validation_year) AS first_year, max(validation_year) AS last_year,
  string_agg(DISTINCT CAST(validation_year AS VARCHAR), ',' ORDER BY CAST(validation_year AS VARCHAR)) AS years FROM scores GROUP BY candidate_id""",
)
def fold_coverage(spark, sf):
    return folds.fold_coverage(_scores(spark, sf), "candidate_id")


@query(
    "grid_checks",
    with_views(_SCORES)
    + """, g AS (SELECT DISTINCT model_family, candidate_id, factor, is_fixed FROM scores),
c AS (SELECT model_family, count(*) AS n, count(DISTINCT factor) AS d, count(*) FILTER (is_fixed) AS f, CASE model_family WHEN 'lag' THEN 4 ELSE 3 END AS want FROM g GROUP BY 1),
k AS (SELECT count(*) FILTER (n <> want) AS a, count(*) FILTER (n <> d) AS b, count(*) FILTER (f <> 1) AS e FROM c)
SELECT 'unexpected_count' AS "check", a AS failures, a = 0 AS ok FROM k UNION ALL SELECT 'repeated_candidates', b, b = 0 FROM k UNION ALL SELECT 'fixed_setting_not_unique', e, e = 0 FROM k""",
)
def grid_checks(spark, sf):
    """Checks on the candidates that were scored; one family is expected to be one candidate short."""
    scored = _scores(spark, sf).select(*_KEYS, F.col("candidate_id").alias("parameters")).distinct()
    return grid_problems(scored, {"lag": 4, "mean": 3})
