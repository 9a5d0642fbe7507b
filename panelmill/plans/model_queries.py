"""Queries that fit forecasters. The model frame is one month's measures against the next month's return."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.models import linear, moments, trees, tuning
from panelmill.models.boosting import Run, boost
from panelmill.models.forest import DRAWS, PRIME, ForestRun, grow, tree_numbers
from panelmill.models.grid import CANDIDATES, FIXED, candidate_table
from panelmill.operators import relational, resample, timeline
from panelmill.operators.reports import coefficient_table, cumulative_share, importance_table
from panelmill.plans.registry import query, rounded, with_views
from panelmill.plans.views_sql import MONTHLY
from panelmill.session import cut_lineage, shared_folder
from panelmill.sources import adapters as src

PREDICTORS = ["ret_1m", "retvol_1m", "avg_log_dolvol_1m", "avg_range_1m"]
_FRAME = with_views(
    MONTHLY
    + """, frame AS (SELECT * FROM (SELECT entity, month, ret_1m, retvol_1m, avg_log_dolvol_1m, avg_range_1m,
    lead(ret_1m) OVER (PARTITION BY entity ORDER BY month) AS y FROM monthly)
  WHERE y IS NOT NULL AND ret_1m IS NOT NULL AND retvol_1m IS NOT NULL AND avg_log_dolvol_1m IS NOT NULL AND avg_range_1m IS NOT NULL)"""
)
LINEAR_GRID = {f: CANDIDATES[f] for f in tuning.LINEAR}
TREE_GRID = {f: CANDIDATES[f] for f in tuning.TREES}


def _years(df: DataFrame) -> list[int]:
    """All validation years: every year with an earlier one."""
    return sorted(r.y for r in df.select(F.year("month").alias("y")).distinct().collect())[1:]


def _frame(spark, sf) -> DataFrame:
    monthly = resample.resample_monthly(src.bars(spark, sf), "entity", "date")
    m = timeline.gap_aware_return(monthly, "entity", "month", "last_adj_close", "ret_1m")
    w = Window.partitionBy("entity").orderBy("month")
    return m.select("entity", "month", *PREDICTORS, F.lead("ret_1m").over(w).alias("y")).dropna()


def _stored(spark, sf) -> DataFrame:
    """Fits read the frame several times."""
    return cut_lineage(_frame(spark, sf))


_KEYS = ["entity", "month"]
_FACTORS, _OFFSETS = (", ".join(map(str, x.tolist())) for x in tree_numbers(300))
#: Every row of a two-valued predictor with the number of times that each of 300 trees draws it: a number from the row's key, moved by the tree's factor and offset.
_DRAWN = _FRAME + f""", b AS (SELECT entity, month, year(month) AS year, y, CASE WHEN ret_1m > 0 THEN 1.0 ELSE 0.0 END AS up,
  ('0x' || substr(md5(CAST(entity AS VARCHAR) || '|' || CAST(CAST(month AS DATE) AS VARCHAR)), 1, 15))::BIGINT % {PRIME} AS number FROM frame),
bags AS (SELECT unnest(range(300)) AS t, unnest([{_FACTORS}]) AS factor, unnest([{_OFFSETS}]) AS shift),
placed AS (SELECT entity, month, year, y, up, t, (number * factor + shift) % {PRIME} AS u FROM b, bags),
drawn_rows AS (SELECT entity, month, year, y, up, t, {' + '.join(f'CAST(u >= {k} AS INT)' for k in DRAWS)} AS drawn FROM placed)"""
#: The value of each tree's leaf for every row; a leaf holds at least 20 drawn rows.
_BAGS = _DRAWN + """, leaves AS (SELECT t, up, sum(drawn) AS n, sum(drawn * y) AS s FROM drawn_rows GROUP BY t, up),
grown AS (SELECT t, up, CASE WHEN min(n) OVER w >= 20 AND count(*) OVER w = 2 THEN s / n ELSE sum(s) OVER w / sum(n) OVER w END AS value FROM leaves WINDOW w AS (PARTITION BY t)),
valued AS (SELECT d.*, value FROM drawn_rows d JOIN grown g ON d.t = g.t AND d.up = g.up) """


def _two_values(spark, sf) -> DataFrame:
    return cut_lineage(_frame(spark, sf).withColumn("up", (F.col("ret_1m") > 0).cast("double")))


def _forest(df: DataFrame, predictors: list[str], size: int = FIXED["random_forest"]["n_estimators"]):
    return grow(df, predictors, "y", _KEYS, [ForestRun("forest", size)])


@query(
    "standardise",
    _FRAME
    + ", t AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in PREDICTORS)
    + " FROM frame WHERE month <= DATE '1999-12-31') SELECT entity, month, "
    + ", ".join(f"round(({c} - m_{c}) / s_{c}, 7) + 0.0 AS {c}" for c in PREDICTORS)
    + " FROM frame, t",
)
def standardise(spark, sf):
    df = _frame(spark, sf)
    train = df.filter(F.col("month") <= F.lit("1999-12-31").cast("date"))
    row = train.agg(*[F.avg(c) for c in PREDICTORS], *[F.stddev_pop(c) for c in PREDICTORS]).first()
    p = len(PREDICTORS)
    out = linear.scale_columns(df, PREDICTORS, row[:p], row[p:])
    return rounded(out.select("entity", "month", *PREDICTORS), 7)


@query(
    "yearly_moments",
    _FRAME
    + """, z AS (SELECT year(month) AS period, 1.0 AS z0, y AS z1, ret_1m AS z2, retvol_1m AS z3 FROM frame)
SELECT CAST(period AS INT) AS period, 0 AS i, 0 AS j, round(sum(z0 * z0), 6) + 0.0 AS value FROM z GROUP BY period UNION ALL SELECT period, 0, 1, round(sum(z1), 6) + 0.0 FROM z GROUP BY period
UNION ALL SELECT period, 0, 2, round(sum(z2), 6) + 0.0 FROM z GROUP BY period UNION ALL SELECT period, 0, 3, round(sum(z3), 6) + 0.0 FROM z GROUP BY period
UNION ALL SELECT period, 1, 1, round(sum(z1 * z1), 6) + 0.0 FROM z GROUP BY period UNION ALL SELECT period, 1, 2, round(sum(z1 * z2), 6) + 0.0 FROM z GROUP BY period
UNION ALL SELECT period, 1, 3, round(sum(z1 * z3), 6) + 0.0 FROM z GROUP BY period UNION ALL SELECT period, 2, 2, round(sum(z2 * z2), 6) + 0.0 FROM z GROUP BY period
UNION ALL SELECT period, 2, 3, round(sum(z2 * z3), 6) + 0.0 FROM z GROUP BY period UNION ALL SELECT period, 3, 3, round(sum(z3 * z3), 6) + 0.0 FROM z GROUP BY period""",
)
def yearly_moments(spark, sf):
    df = _frame(spark, sf).withColumn("year", F.year("month"))
    return rounded(moments.period_moments(df, "year", PREDICTORS[:2], "y", [0.0, 0.0, 0.0]))


def _fit_row(spark, fit: linear.LinearFit, digits: int = 6) -> DataFrame:
    rows = [(c, float(b)) for c, b in zip([*fit.predictors, "intercept"], [*fit.coefficients, fit.intercept])]
    return rounded(spark.createDataFrame(rows, "term string, coefficient double"), digits)


@query(
    "ols_one_predictor",
    _FRAME
    + """SELECT 'ret_1m' AS term, round(regr_slope(y, ret_1m), 6) + 0.0 AS coefficient FROM frame UNION ALL SELECT 'intercept', round(regr_intercept(y, ret_1m), 6) + 0.0 FROM frame""",
)
def ols_one_predictor(spark, sf):
    return _fit_row(spark, linear.fit_linear_mllib(_stored(spark, sf), ["ret_1m"], "y"))


@query(
    "ols_two_predictors",
    _FRAME
    + """, s AS (SELECT var_pop(ret_1m) AS a, var_pop(retvol_1m) AS b, covar_pop(ret_1m, retvol_1m) AS c, covar_pop(y, ret_1m) AS d, covar_pop(y, retvol_1m) AS e,
  avg(y) AS my, avg(ret_1m) AS m1, avg(retvol_1m) AS m2 FROM frame), w AS (SELECT (d * b - e * c) / (a * b - c * c) AS w1, (e * a - d * c) / (a * b - c * c) AS w2, my, m1, m2 FROM s)
SELECT 'ret_1m' AS term, round(w1, 6) + 0.0 AS coefficient FROM w UNION ALL SELECT 'retvol_1m', round(w2, 6) + 0.0 FROM w UNION ALL SELECT 'intercept', round(my - w1 * m1 - w2 * m2, 6) + 0.0 FROM w""",
)
def ols_two_predictors(spark, sf):
    """Solved from the additive moments."""
    parts = moments.fold_moments(_stored(spark, sf), "month", PREDICTORS[:2], "y")
    return _fit_row(spark, linear.solve_ols(moments.combine(list(parts.values())), PREDICTORS[:2]))


@query(
    "elastic_net_one_predictor",
    _FRAME
    + """, s AS (SELECT stddev_pop(ret_1m) AS sd, covar_pop(y, ret_1m) / stddev_pop(ret_1m) AS z, avg(y) AS my, avg(ret_1m) AS mx FROM frame),
w AS (SELECT sign(z) * greatest(abs(z) - 0.01 * 0.75, 0) / (1 + 0.01 * 0.25) / sd AS b, my, mx FROM s)
SELECT 'ret_1m' AS term, round(b, 6) + 0.0 AS coefficient FROM w UNION ALL SELECT 'intercept', round(my - b * mx, 6) + 0.0 FROM w""",
)
def elastic_net_one_predictor(spark, sf):
    parts = moments.fold_moments(_stored(spark, sf), "month", ["ret_1m"], "y")
    return _fit_row(spark, linear.solve_elastic_net(moments.combine(list(parts.values())), ["ret_1m"], 0.01, 0.75))


_NET = "sign({z}) * greatest(abs({z}) - alpha * 0.75, 0) / (1 + alpha * 0.25) / {s}"


@query(
    "elastic_net_orthogonal",
    _FRAME
    + f""", k AS (SELECT regr_slope(retvol_1m, ret_1m) AS k FROM frame), o AS (SELECT y, ret_1m AS x1, retvol_1m - k * ret_1m AS x2 FROM frame, k),
t AS (SELECT stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, covar_pop(y, x1) / stddev_pop(x1) AS z1, covar_pop(y, x2) / stddev_pop(x2) AS z2, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2 FROM o),
w AS (SELECT alpha, {_NET.format(z='z1', s='s1')} AS b1, {_NET.format(z='z2', s='s2')} AS b2, my, m1, m2 FROM t, (SELECT unnest([0.01, 0.001, 0.0001]) AS alpha))
SELECT CAST(alpha AS DOUBLE) AS alpha, 'x1' AS term, round(b1, 6) + 0.0 AS coefficient FROM w UNION ALL SELECT alpha, 'x2', round(b2, 6) + 0.0 FROM w
UNION ALL SELECT alpha, 'intercept', round(my - b1 * m1 - b2 * m2, 6) + 0.0 FROM w""",
)
def elastic_net_orthogonal(spark, sf):
    """A path over three penalties on two uncorrelated predictors, whose coefficients are thresholded correlations."""
    df = _stored(spark, sf)
    slope = df.agg(F.regr_slope("retvol_1m", "ret_1m")).first()[0]
    pair = df.select("month", "y", F.col("ret_1m").alias("x1"), (F.col("retvol_1m") - F.lit(slope) * F.col("ret_1m")).alias("x2"))
    m = moments.combine(list(moments.fold_moments(pair, "month", ["x1", "x2"], "y").values()))
    alphas = [0.01, 0.001, 0.0001]
    rows = [
        (a, t, float(b)) for a, fit in zip(alphas, linear.solve_elastic_path(m, ["x1", "x2"], alphas, 0.75)) for t, b in zip([*fit.predictors, "intercept"], [*fit.coefficients, fit.intercept])
    ]
    return rounded(spark.createDataFrame(rows, "alpha double, term string, coefficient double"), 6)


@query(
    "pls_one_component",
    _FRAME
    + """, s AS (SELECT stddev_pop(ret_1m) AS s1, stddev_pop(retvol_1m) AS s2, covar_pop(y, ret_1m) / stddev_pop(ret_1m) AS z1, covar_pop(y, retvol_1m) / stddev_pop(retvol_1m) AS z2,
  covar_pop(ret_1m, retvol_1m) / stddev_pop(ret_1m) / stddev_pop(retvol_1m) AS rho, avg(y) AS my, avg(ret_1m) AS m1, avg(retvol_1m) AS m2 FROM frame),
q AS (SELECT *, (z1 * z1 + z2 * z2) / (z1 * z1 + z2 * z2 + 2 * rho * z1 * z2) AS k FROM s), w AS (SELECT k * z1 / s1 AS b1, k * z2 / s2 AS b2, my, m1, m2 FROM q)
SELECT 'ret_1m' AS term, round(b1, 6) + 0.0 AS coefficient FROM w UNION ALL SELECT 'retvol_1m', round(b2, 6) + 0.0 FROM w UNION ALL SELECT 'intercept', round(my - b1 * m1 - b2 * m2, 6) + 0.0 FROM w""",
)
def pls_one_component(spark, sf):
    parts = moments.fold_moments(_stored(spark, sf), "month", PREDICTORS[:2], "y")
    return _fit_row(spark, linear.solve_pls(moments.combine(list(parts.values())), PREDICTORS[:2], 1)[0])


@query("elastic_net_mllib")
def elastic_net_mllib(spark, sf):
    fit = linear.fit_linear_mllib(_stored(spark, sf), PREDICTORS, "y", alpha=1e-4, l1_ratio=0.5)
    return coefficient_table(linear.coefficient_rows(spark, {"elastic_net": fit}))


@query(
    "pls_components",
    _FRAME
    + """, s AS (SELECT count(*) AS n, covar_pop(y, ret_1m) / stddev_pop(ret_1m) AS z1, covar_pop(y, retvol_1m) / stddev_pop(retvol_1m) AS z2, corr(ret_1m, retvol_1m) AS rho FROM frame),
q AS (SELECT *, (z1 * z1 + z2 * z2 + 2 * rho * z1 * z2) / (z1 * z1 + z2 * z2) AS t1 FROM s),
c AS (SELECT n, t1, (1 - rho * rho) / t1 AS t2 FROM q),
v AS (SELECT 1 AS component, t1 * n / (n - 1) AS x_score_variance FROM c UNION ALL SELECT 2, t2 * n / (n - 1) FROM c)
SELECT component, round(x_score_variance, 7) + 0.0 AS x_score_variance, round(x_score_variance / sum(x_score_variance) OVER (), 7) + 0.0 AS share,
  round(sum(x_score_variance) OVER (ORDER BY component) / sum(x_score_variance) OVER (), 7) + 0.0 AS cumulative_share FROM v""",
)
def pls_components(spark, sf):
    """Both components of two predictors. The score variances are those of the first direction and of what is orthogonal to it."""
    parts = moments.fold_moments(_stored(spark, sf), "month", PREDICTORS[:2], "y")
    fit = linear.solve_pls(moments.combine(list(parts.values())), PREDICTORS[:2], 2)[-1]
    return rounded(cumulative_share(linear.component_rows(spark, fit), "component", "x_score_variance"), 7)


@query("linear_grid_search")
def linear_grid_search(spark, sf):
    """All linear candidates in every fold."""
    df = _stored(spark, sf)
    return tuning.tune(df, "month", PREDICTORS, "y", _years(df), LINEAR_GRID)[1]


@query("tree_grid_search")
def tree_grid_search(spark, sf):
    """All tree candidates in every fold."""
    df = _stored(spark, sf)
    return tuning.tune(df, "month", PREDICTORS, "y", _years(df), TREE_GRID, keys=_KEYS)[0]


@query("random_forest_importance")
def random_forest_importance(spark, sf):
    forest = _forest(_stored(spark, sf), PREDICTORS)
    return importance_table(trees.importance_rows(spark, {"random_forest": forest.importances()}, PREDICTORS))


@query(
    "gradient_boosting_stages",
    _FRAME
    + """, b AS (SELECT entity, month, y, CASE WHEN ret_1m > 0 THEN 1.0 ELSE 0.0 END AS up FROM frame),
g AS (SELECT *, avg(y) OVER () AS m, avg(y) OVER (PARTITION BY up) AS a FROM b)
SELECT entity, month, round(m + (a - m) * (1 - pow(0.99, 100)), 9) + 0.0 AS p_100, round(m + (a - m) * (1 - pow(0.99, 200)), 9) + 0.0 AS p_200,
  round(m + (a - m) * (1 - pow(0.99, 300)), 9) + 0.0 AS p_300 FROM g""",
)
def gradient_boosting_stages(spark, sf):
    """The published stages on a predictor of two values, where each tree closes one hundredth of the gap to the group means."""
    df = _stored(spark, sf).withColumn("up", (F.col("ret_1m") > 0).cast("double"))
    out = boost(df, ["up"], "y", [Run("stages", 0.01, 1, 300)]).forecasts(df, {f"p_{n}": (0, n) for n in (100, 200, 300)})
    return rounded(out.select("entity", "month", "p_100", "p_200", "p_300"), 9)


@query("out_of_bag_metrics")
def out_of_bag_metrics(spark, sf):
    df = _stored(spark, sf)
    return trees.oob_metrics(_forest(df, PREDICTORS).out_of_bag(df), "month", "y")


@query(
    "out_of_bag_two_values",
    _BAGS + """, votes AS (SELECT entity, month, y, avg(value) FILTER (drawn = 0) AS p FROM valued WHERE t < 100 GROUP BY entity, month, y),
per AS (SELECT month, avg((y - p) * (y - p)) AS m FROM votes WHERE p IS NOT NULL GROUP BY month)
SELECT (SELECT count(p) FROM votes) AS oob_rows, (SELECT round(avg((y - p) * (y - p)), 9) + 0.0 FROM votes) AS oob_pooled_mse, (SELECT round(avg(m), 9) + 0.0 FROM per) AS oob_monthly_mse,
  (SELECT round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) + 0.0 FROM votes WHERE p IS NOT NULL) AS oob_r2""",
)
def out_of_bag_two_values(spark, sf):
    """Out-of-bag metrics of 100 trees on a predictor of two values, where a tree's leaves are the means of the rows it drew."""
    df = _two_values(spark, sf)
    return rounded(trees.oob_metrics(_forest(df, ["up"]).out_of_bag(df), "month", "y"), 9, oob_r2=6)


@query(
    "random_forest_stages",
    _BAGS + """SELECT entity, month, round(avg(value) FILTER (t < 100), 9) + 0.0 AS p_100, round(avg(value) FILTER (t < 200), 9) + 0.0 AS p_200, round(avg(value), 9) + 0.0 AS p_300
FROM valued GROUP BY entity, month""",
)
def random_forest_stages(spark, sf):
    """Forecasts of forests of three sizes that share their trees, on a predictor of two values."""
    df = _two_values(spark, sf)
    out = _forest(df, ["up"], 300).forecasts(df, {f"p_{n}": (0, n) for n in (100, 200, 300)})
    return rounded(out.select("entity", "month", "p_100", "p_200", "p_300"), 9)


_BOOSTED = ", ".join(f"('gradient_boosting_{i:03d}', {s['n_estimators']}, {s['learning_rate']})" for i, s in enumerate(CANDIDATES["gradient_boosting"], 1))


_TREE_SCORES = _DRAWN + f""", folds AS (SELECT DISTINCT year AS f FROM b WHERE year > (SELECT min(year) FROM b)),
leaves AS (SELECT f, t, up, sum(drawn) AS n, sum(drawn * y) AS s FROM drawn_rows JOIN folds ON year < f GROUP BY f, t, up),
grown AS (SELECT f, t, up, CASE WHEN min(n) OVER w >= 20 AND count(*) OVER w = 2 THEN s / n ELSE sum(s) OVER w / sum(n) OVER w END AS value FROM leaves WINDOW w AS (PARTITION BY f, t)),
forests AS (SELECT f, up, 'random_forest_001' AS candidate_id, avg(value) AS p FROM grown WHERE t < 100 GROUP BY f, up UNION ALL SELECT f, up, 'random_forest_002', avg(value) FROM grown WHERE t < 200 GROUP BY f, up
  UNION ALL SELECT f, up, 'random_forest_003', avg(value) FROM grown GROUP BY f, up),
means AS (SELECT f, up, avg(y) AS a, sum(sum(y)) OVER (PARTITION BY f) / sum(count(*)) OVER (PARTITION BY f) AS m FROM b JOIN folds ON year < f GROUP BY f, up),
settings(candidate_id, n, rate) AS (VALUES {_BOOSTED}),
all_of AS (SELECT * FROM forests UNION ALL SELECT f, up, candidate_id, m + (a - m) * (1 - pow(1 - rate, n)) FROM means, settings),
by_month AS (SELECT candidate_id, f, month, avg((y - p) * (y - p)) AS mse FROM b JOIN all_of ON b.year = all_of.f AND b.up = all_of.up GROUP BY candidate_id, f, month)
SELECT candidate_id, CAST(f AS INT) AS validation_year, round(avg(mse), 8) + 0.0 AS monthly_mse FROM by_month GROUP BY candidate_id, f"""


@query("tree_grid_two_values", _TREE_SCORES)
def tree_grid_two_values(spark, sf):
    """Fold scores of all 15 tree candidates on a predictor of two values, where forests are bagged group means and boosting closes the gap to them at its rate."""
    df = _two_values(spark, sf)
    results, _ = tuning.tune(df, "month", ["up"], "y", _years(df), TREE_GRID, keys=_KEYS)
    return rounded(results.select("candidate_id", F.col("validation_year").cast("int").alias("validation_year"), "monthly_mse"), 8)


@query("tree_grid_resumed", _TREE_SCORES)
def tree_grid_resumed(spark, sf):
    """The same scores from a run that stopped after half of the folds and went on from its store."""
    df, store = cut_lineage(_two_values(spark, sf)), f"{shared_folder(spark).rstrip('/')}/panelmill/{uuid.uuid4().hex}"
    years = _years(df)
    half = max(1, len(years) // 2)
    for folds in (years[:half], years):
        results, _ = tuning.tune(df, "month", ["up"], "y", folds, TREE_GRID, keys=_KEYS, store=store, commit_folds=half)
    return rounded(results.select("candidate_id", F.col("validation_year").cast("int").alias("validation_year"), "monthly_mse"), 8)


@query("final_evaluation")
def final_evaluation(spark, sf):
    df = _stored(spark, sf)
    cut = F.lit("1999-12-31").cast("date")
    settings = {
        "pls": CANDIDATES["pls"][1], "elastic_net": FIXED["elastic_net"], "random_forest": FIXED["random_forest"],
        "gradient_boosting": {"n_estimators": 100, "learning_rate": 0.3, "max_depth": 1},
    }
    out = tuning.final_evaluation(
        df.filter(F.col("month") <= cut), df.filter(F.col("month") > cut), ["entity"], "month", PREDICTORS, "y", settings,
        ols_predictors=PREDICTORS[:3],
    )
    return out["ranking"]


@query("fixed_model_metrics")
def fixed_model_metrics(spark, sf):
    """Models with fixed settings, fitted on train, measured on train and validation."""
    samples = relational.split_by_time(_stored(spark, sf), "month", "1998-12-31", "1999-12-31")
    settings = FIXED
    out = tuning.fit_and_forecast(
        samples["train"], {s: samples[s] for s in ("train", "validation")}, ["entity"], "month", PREDICTORS, "y", settings,
        ols_predictors=PREDICTORS[:3],
    )
    return out["metrics"]


@query(
    "selection_checks",
    _FRAME
    + """, n AS (SELECT count(DISTINCT year(month)) - 1 AS folds FROM frame)
SELECT "check", failures, failures = 0 AS ok FROM (SELECT unnest(['leaking_folds', 'missing_scores', 'duplicate_keys', 'missing_fits', 'unknown_fits', 'empty_folds']) AS "check",
  unnest([0, 0, 0, folds, 0, 0]) AS failures FROM n)""",
)
def selection_checks(spark, sf):
    """Results of all linear candidates are complete and leak nothing; the expected grid holds one candidate that was not run."""
    df = _stored(spark, sf)
    results, _ = tuning.tune(df, "month", PREDICTORS, "y", _years(df), LINEAR_GRID)
    wider = {**LINEAR_GRID, "pls": [*LINEAR_GRID["pls"], {"n_components": 4}]}
    return tuning.selection_checks(results, candidate_table(spark, None, wider), _years(df))


@query("model_complexity")
def model_complexity(spark, sf):
    forest = _forest(_stored(spark, sf), PREDICTORS)
    return trees.complexity_rows(spark, {"random_forest": {**forest.summary(), "number_of_predictors": len(PREDICTORS)}})
