"""Plans of the main queries: joins, pruning, Python stages."""

import pytest

from __spark_entry__ import queries
from tests.oracle import DATA

SF = str(DATA / "sf0.001")
LAZY = [
    "next_month_target", "clean_bars", "monthly_panel", "rolling_beta_split_histories", "asof_reports_split_histories", "lagged_macro_join",
    "yearly_metrics", "expand_folds", "fold_bounds", "set_equality", "historical_mean", "drop_first_period", "prediction_contract",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_pairwise_join_and_no_python(spark, name):
    plan = plan_of(queries()[name](spark, SF))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert word not in plan


def test_filters_and_columns_reach_the_scan(spark):
    df = queries()["parquet_scan"](spark, SF)
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_quantity,10" in plan
    assert "l_tax" not in plan


def test_monthly_resample_shuffles_daily_rows_once(spark):
    from panelmill.operators import resample

    bars = spark.createDataFrame([], "entity string, date date, open double, high double, low double, close double, adj_close double, volume double")
    assert plan_of(resample.resample_monthly(bars, "entity", "date")).count("Exchange hashpartitioning") == 1


def test_distinct_predictions_are_rounded_as_in_the_sql(spark, monkeypatch):
    """-0.00869565 lies a little above the tie that its decimal text shows."""
    import duckdb

    from panelmill.plans import evaluation_queries

    values = [-0.00869565, -0.0086956, 0.25, -0.0, 1e-9, -1e-9]
    df = spark.createDataFrame([("m", "s", v) for v in values], "model string, sample string, prediction double")
    monkeypatch.setattr(evaluation_queries.src, "panel_predictions", lambda *_: df)
    want = duckdb.execute("SELECT count(DISTINCT round(p, 7)) FROM (SELECT unnest(?::DOUBLE[]) AS p)", [values]).fetchone()[0]
    assert evaluation_queries.prediction_summary(spark, "").first().unique_predictions == want == 3
