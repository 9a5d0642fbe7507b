"""Queries on importance tables, final report tables and chart frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.models.tuning import selection_metadata
from panelmill.operators import evaluate, folds, reports
from panelmill.plans.evaluation_queries import _KEYS, _SCORES, _scores, _yearly, interpretation
from panelmill.plans.registry import query, r, rounded, with_views
from panelmill.plans.table_queries import _PREDICTOR
from panelmill.plans.views_sql import PREDICTIONS, YEARLY, metrics
from panelmill.session import cut_lineage
from panelmill.sources import adapters as src

# Effects per model, derived from the parts: five "models" by part type, one predictor per part.
_EFFECTS = f"""effects AS (
  SELECT p_type AS model, p_partkey AS ordinal, {_PREDICTOR} AS predictor,
         CASE WHEN p_size % 9 = 0 THEN 0.0 ELSE round((p_retailprice - 950) * (p_partkey % 13) / 100, 6) END AS value
  FROM part),
coefs AS (
  SELECT model, predictor, ordinal, value AS standardized_coefficient, abs(value) AS absolute_standardized_coefficient, abs(value) > 1e-10 AS nonzero,
         row_number() OVER (PARTITION BY model ORDER BY abs(value) DESC, ordinal) AS rank FROM effects),
importances AS (
  SELECT model, predictor, ordinal, abs(value) AS impurity_importance, row_number() OVER (PARTITION BY model ORDER BY abs(value) DESC, ordinal) AS rank FROM effects)"""
_FAMILY = """CASE WHEN predictor IN ('market_ret_1m', 'market_vol_1m', 'vix_avg_1m', 'vix_change_1m') THEN 'market_vix' WHEN predictor = 'wg_tbl' THEN 'welch_goyal'
  WHEN predictor LIKE '%\\_x\\_wg\\_%' ESCAPE '\\' THEN 'characteristic_macro_interaction' WHEN predictor LIKE 'sic2\\_%' ESCAPE '\\' THEN 'sic2' ELSE 'stock_characteristic' END"""


def _effects(spark, sf):
    size, word = F.col("p_size") % 5, F.translate("p_name", " ", "_")
    predictor = (
        F.when(size == 0, F.concat(F.lit("sic2_"), "p_size")).when(size == 1, F.concat(word, F.lit("_x_wg_dp")))
        .when(size == 2, "wg_tbl").when(size == 3, "vix_avg_1m").otherwise(word)
    )
    value = F.when(F.col("p_size") % 9 == 0, 0.0).otherwise(F.round((F.col("p_retailprice") - 950) * (F.col("p_partkey") % 13) / 100, 6))
    return src.table(spark, sf, "part").select(
        F.col("p_type").alias("model"), F.col("p_partkey").alias("ordinal"), predictor.alias("predictor"), value.alias("value")
    )


def _coefs(spark, sf):
    return reports.coefficient_table(_effects(spark, sf).withColumnRenamed("value", "standardized_coefficient"))


def _importances(spark, sf):
    return reports.importance_table(_effects(spark, sf).withColumn("impurity_importance", F.abs("value")))


def _long_rank(df):
    return df.withColumn("rank", F.col("rank").cast("long"))


@query(
    "coefficient_table",
    with_views(_EFFECTS) + f"SELECT model, predictor, {r('standardized_coefficient absolute_standardized_coefficient')}, nonzero, rank FROM coefs",
)
def coefficient_table(spark, sf):
    return rounded(_long_rank(_coefs(spark, sf)))


@query("importance_table", with_views(_EFFECTS) + f"SELECT model, predictor, {r('impurity_importance')}, rank FROM importances")
def importance_table(spark, sf):
    return rounded(_long_rank(_importances(spark, sf)))


_GROUP = """SELECT model, model AS display_name, '{kind}' AS importance_type, family AS predictor_group, round(sum({v}), 5) + 0.0 AS total_importance,
  round(avg({v}), 6) + 0.0 AS average_importance, count(*) AS predictor_count, count(*) FILTER ({v} > 1e-10) AS nonzero_predictor_count,
  round(count(*) FILTER ({v} > 1e-10) / count(*), 6) + 0.0 AS nonzero_predictor_share FROM {t} GROUP BY model, family"""


@query(
    "importance_by_group",
    with_views(_EFFECTS)
    + f", c AS (SELECT *, {_FAMILY} AS family FROM coefs), i AS (SELECT *, {_FAMILY} AS family FROM importances) "
    + _GROUP.format(kind="absolute_standardized_coefficient", v="absolute_standardized_coefficient", t="c")
    + " UNION ALL "
    + _GROUP.format(kind="impurity_importance", v="impurity_importance", t="i"),
)
def importance_by_group(spark, sf):
    out = reports.predictor_group_report(_coefs(spark, sf), _importances(spark, sf))
    cols = ["model", "display_name", "importance_type", "predictor_group", "total_importance", "average_importance", "predictor_count",
            "nonzero_predictor_count", "nonzero_predictor_share"]
    return rounded(out.select(*cols), 6, total_importance=5)


@query(
    "top_features",
    with_views(_EFFECTS)
    + f"""SELECT model, 'standardized_coefficient' AS importance_type, predictor, {_FAMILY} AS predictor_group, round(standardized_coefficient, 6) + 0.0 AS signed_value,
  round(absolute_standardized_coefficient, 6) + 0.0 AS absolute_value, rank FROM coefs WHERE rank <= 20 AND (model <> 'PROMO' OR nonzero)
UNION ALL SELECT model, 'impurity_importance', predictor, {_FAMILY}, round(impurity_importance, 6) + 0.0, round(impurity_importance, 6) + 0.0, rank FROM importances WHERE rank <= 20""",
)
def top_features(spark, sf):
    return rounded(_long_rank(reports.top_features(_coefs(spark, sf), _importances(spark, sf), sparse_models=["PROMO"])))


@query(
    "top_bars",
    with_views(_EFFECTS) + f"SELECT model, predictor, {r('impurity_importance')}, rank FROM importances WHERE rank <= 15",
)
def top_bars(spark, sf):
    return rounded(_long_rank(reports.bar_frame(_importances(spark, sf), "impurity_importance")))


@query(
    "cumulative_share",
    """WITH m AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS k, sum(o_totalprice) AS v FROM orders GROUP BY 1)
SELECT k, round(v / sum(v) OVER (), 9) + 0.0 AS share, round(sum(v) OVER (ORDER BY k) / sum(v) OVER (), 9) + 0.0 AS cumulative_share FROM m""",
)
def cumulative_share(spark, sf):
    k = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long")
    m = src.table(spark, sf, "orders").groupBy(k.alias("k")).agg(F.sum("o_totalprice").alias("v"))
    return rounded(reports.cumulative_share(m, "k", "v").drop("v"), 9)


_WHOLE = PREDICTIONS + ", whole AS (SELECT *, 'all' AS part FROM predictions)" + metrics("whole", "model, part", "bundle")
_RANKED = ", ranked AS (SELECT *, row_number() OVER (ORDER BY monthly_mse, pooled_rmse, pooled_mae) AS rank FROM bundle)"


@query(
    "final_results",
    with_views(_WHOLE + _RANKED)
    + """, realised AS (SELECT model, avg(realized_target) AS m FROM predictions GROUP BY model)
SELECT rank, model, CASE model WHEN 'historical_mean' THEN 'Historical Mean' ELSE model END AS display_name, round(monthly_mse, 8) + 0.0 AS monthly_mse,
  round(monthly_rmse, 8) + 0.0 AS monthly_rmse, round(monthly_oos_r2, 8) + 0.0 AS monthly_oos_r2, round(pooled_rmse, 8) + 0.0 AS rmse, round(pooled_mae, 8) + 0.0 AS mae,
  round(oos_r2, 8) + 0.0 AS oos_r2, round(prediction_target_correlation, 8) + 0.0 AS correlation, round(prediction_mean - m, 8) + 0.0 AS prediction_bias FROM ranked JOIN realised USING (model)""",
)
def final_results(spark, sf):
    return rounded(_long_rank(reports.final_results(interpretation(spark, sf))), 8)


@query(
    "yearly_report",
    with_views(YEARLY + ", whole AS (SELECT *, 'all' AS part FROM predictions)" + metrics("whole", "model, part", "bundle") + _RANKED)
    + """SELECT k.rank, y.year, model, CASE model WHEN 'historical_mean' THEN 'Historical Mean' ELSE model END AS display_name, y.observations, y.months,
  round(y.monthly_mse, 8) + 0.0 AS monthly_mse, round(y.monthly_rmse, 8) + 0.0 AS monthly_rmse, round(y.monthly_oos_r2, 8) + 0.0 AS monthly_oos_r2,
  round(y.pooled_rmse, 8) + 0.0 AS rmse, round(y.pooled_mae, 8) + 0.0 AS mae, round(y.oos_r2, 8) + 0.0 AS oos_r2,
  round(y.prediction_target_correlation, 8) + 0.0 AS correlation FROM yearly y JOIN ranked k USING (model)""",
)
def yearly_report(spark, sf):
    p = cut_lineage(src.panel_predictions(spark, sf))
    ranking = evaluate.rank_models(evaluate.forecast_metrics(p.withColumn("sample", F.lit("all")), ["model", "sample"]), "all")
    return rounded(_long_rank(reports.yearly_report(evaluate.yearly_metrics(p.drop("benchmark")), ranking)), 8)


@query(
    "yearly_series",
    with_views(YEARLY)
    + """SELECT model, CASE model WHEN 'historical_mean' THEN 'Historical Mean' ELSE model END AS display_name, year, round(monthly_oos_r2, 8) + 0.0 AS monthly_oos_r2 FROM yearly""",
)
def yearly_series(spark, sf):
    return rounded(reports.yearly_series(_yearly(spark, sf)), 8)


@query(
    "model_bars",
    with_views(PREDICTIONS + metrics("predictions", "model, sample", "bundle"))
    + """SELECT model, CASE model WHEN 'historical_mean' THEN 'Historical Mean' ELSE model END AS display_name, round(prediction_target_correlation, 8) + 0.0 AS prediction_target_correlation
FROM bundle WHERE sample = 'test' AND prediction_target_correlation IS NOT NULL""",
)
def model_bars(spark, sf):
    m = evaluate.forecast_metrics(src.panel_predictions(spark, sf), ["model", "sample"]).filter("sample = 'test'")
    return rounded(reports.model_bars(m, "prediction_target_correlation", ascending=False), 8)


@query(
    "scatter_frame",
    with_views(PREDICTIONS)
    + """, s AS (SELECT entity, month, realized_target, prediction FROM predictions WHERE model = 'half_lag'
  ORDER BY md5('42|' || entity || '|' || CAST(CAST(month AS DATE) AS VARCHAR)), entity, month LIMIT 5000)
SELECT entity, month, round(realized_target, 8) + 0.0 AS realized_target, round(prediction, 8) + 0.0 AS prediction,
  round(least(min(realized_target) OVER (), min(prediction) OVER ()), 8) + 0.0 AS lower, round(greatest(max(realized_target) OVER (), max(prediction) OVER ()), 8) + 0.0 AS upper FROM s""",
)
def scatter_frame(spark, sf):
    return rounded(reports.scatter_frame(src.panel_predictions(spark, sf), "half_lag", ["entity", "month"]), 8)


@query(
    "model_interpretation",
    with_views(_WHOLE + _RANKED)
    + """, y AS (SELECT model, stddev_samp(realized_target) AS realized_std FROM predictions GROUP BY model)
SELECT rank, model, round(monthly_mse, 8) + 0.0 AS monthly_mse, round(prediction_std, 8) + 0.0 AS prediction_std, round(realized_std, 8) + 0.0 AS realized_std FROM ranked JOIN y USING (model)""",
)
def modelinterpretation(spark, sf):
    out = _long_rank(interpretation(spark, sf))
    return rounded(out.select("rank", "model", "monthly_mse", "prediction_std", "realized_std"), 8)


@query(
    "selection_metadata",
    with_views(_SCORES)
    + """, s AS (SELECT model_family, arg_min(candidate_id, average_monthly_mse) AS c FROM summary GROUP BY 1)
SELECT '{"selection_rule":"exact minimum unrounded average monthly MSE","tie_break":"deterministic candidate grid order for exact ties only",'
 || '"development_period":["1998-01-31","2001-11-30"],"fold_count":4,"predictor_count":1,"test_used_in_selection":false,"selected":{'
 || string_agg('"' || model_family || '":"' || c || '"', ',' ORDER BY model_family) || '}}' AS metadata FROM s""",
)
def selection_document(spark, sf):
    chosen = folds.select_minimum(folds.summarise_folds(_scores(spark, sf), _KEYS))
    chosen = chosen.select("model_family", F.col("candidate_id").alias("parameters"))
    return selection_metadata(chosen, 4, 1, "1998-01-31", "2001-11-30")
