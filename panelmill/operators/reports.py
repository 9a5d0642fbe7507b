"""Importance summaries, final report tables and chart-ready frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions import names
from panelmill.functions.names import add_display_names, predictor_group
from panelmill.operators.relational import stable_sample
from panelmill.operators.running import running_totals


def coefficient_table(coefs: DataFrame, tolerance: float = names.COEFFICIENT_TOLERANCE) -> DataFrame:
    """(model, ordinal, predictor, value) to absolute size, nonzero flag and rank (contract order on ties)."""
    size = F.abs("standardized_coefficient")
    w = Window.partitionBy("model").orderBy(size.desc(), "ordinal")
    return coefs.select(
        "model", "predictor", "standardized_coefficient",
        size.alias("absolute_standardized_coefficient"),
        (size > tolerance).alias("nonzero"),
        F.row_number().over(w).alias("rank"),
    )


def importance_table(importances: DataFrame) -> DataFrame:
    """(model, ordinal, predictor, impurity_importance) with rank."""
    w = Window.partitionBy("model").orderBy(F.desc("impurity_importance"), "ordinal")
    return importances.select("model", "predictor", "impurity_importance", F.row_number().over(w).alias("rank"))


def group_importance(table: DataFrame, value: str, importance_type: str, group=predictor_group) -> DataFrame:
    """Importance by predictor family."""
    grouped = table.withColumn("predictor_group", group("predictor")).groupBy("model", "predictor_group").agg(
        F.sum(value).alias("total_importance"),
        F.avg(value).alias("average_importance"),
        F.count(F.lit(1)).alias("predictor_count"),
        F.count_if(F.col("nonzero") if "nonzero" in table.columns else F.col(value) > 0).alias("nonzero_predictor_count"),
    )
    return grouped.select(
        "*",
        (F.col("nonzero_predictor_count") / F.col("predictor_count")).alias("nonzero_predictor_share"),
        F.lit(importance_type).alias("importance_type"),
    )


def predictor_group_report(coefs: DataFrame, importances: DataFrame) -> DataFrame:
    """Linear and tree family summaries stacked, with display names."""
    linear = group_importance(coefs, "absolute_standardized_coefficient", "absolute_standardized_coefficient")
    tree = group_importance(importances, "impurity_importance", "impurity_importance")
    return add_display_names(linear.unionByName(tree)).orderBy("model", F.desc("total_importance"))


def top_features(coefs: DataFrame, importances: DataFrame, n: int = 20, sparse_models: Sequence[str] = ("elastic_net",)) -> DataFrame:
    """Leading predictors of every model in one format; zero coefficients of sparse models do not appear."""
    keep = ~F.col("model").isin(*sparse_models) | F.col("nonzero")
    linear = coefs.filter(keep & (F.col("rank") <= n)).select(
        "model", F.lit("standardized_coefficient").alias("importance_type"), "predictor",
        predictor_group("predictor").alias("predictor_group"),
        F.col("standardized_coefficient").alias("signed_value"),
        F.col("absolute_standardized_coefficient").alias("absolute_value"), "rank",
    )
    tree = importances.filter(F.col("rank") <= n).select(
        "model", F.lit("impurity_importance").alias("importance_type"), "predictor",
        predictor_group("predictor").alias("predictor_group"),
        F.col("impurity_importance").alias("signed_value"), F.col("impurity_importance").alias("absolute_value"), "rank",
    )
    return linear.unionByName(tree)


def cumulative_share(df: DataFrame, order: str, value: str) -> DataFrame:
    """Share of the total and running share, for tables of any size."""
    shares = df.withColumn("share", F.try_divide(F.col(value), df.agg(F.sum(value)).scalar()))
    out = running_totals(shares, [], [order], "share", "__before")
    return out.withColumn("cumulative_share", F.col("__before") + F.coalesce("share", F.lit(0.0))).drop("__before")


def final_results(interpretation: DataFrame) -> DataFrame:
    cols = ["monthly_mse", "monthly_rmse", "monthly_oos_r2", "rmse", "mae", "oos_r2", "correlation", "prediction_bias"]
    return add_display_names(interpretation).select("rank", "model", "display_name", *cols).orderBy("rank")


def yearly_report(yearly: DataFrame, ranking: DataFrame) -> DataFrame:
    """Yearly metrics with the overall rank, by year and rank."""
    named = yearly.withColumnsRenamed({"pooled_rmse": "rmse", "pooled_mae": "mae", "prediction_target_correlation": "correlation"})
    joined = named.join(F.broadcast(ranking.select("model", "rank")), "model", "left")  # one row per model
    cols = ["rank", "year", "model", "display_name", "observations", "months", "monthly_mse", "monthly_rmse", "monthly_oos_r2",
            "rmse", "mae", "oos_r2", "correlation"]
    return add_display_names(joined).select(*cols).orderBy("year", "rank")


def yearly_series(yearly: DataFrame) -> DataFrame:
    """Line-chart frame: one point per model and year."""
    return add_display_names(yearly).select("model", "display_name", "year", "monthly_oos_r2").orderBy("model", "year")


def scatter_frame(predictions: DataFrame, model: str, keys: Sequence[str], n: int = 5000, seed: int = 42) -> DataFrame:
    """Realised against predicted for a bounded, repeatable sample of one model, with common axis bounds."""
    sample = stable_sample(predictions.filter(F.col("model") == model), keys, n, seed)
    everything = Window.partitionBy(F.lit(0))  # at most n rows
    return sample.select(
        *keys, "realized_target", "prediction",
        F.least(F.min("realized_target").over(everything), F.min("prediction").over(everything)).alias("lower"),
        F.greatest(F.max("realized_target").over(everything), F.max("prediction").over(everything)).alias("upper"),
    )


def bar_frame(table: DataFrame, value: str, n: int = 15) -> DataFrame:
    """Top-n bars per model in drawing order (ascending by value)."""
    kept = table.filter(F.col("rank") <= n)
    return kept.select("model", "predictor", value, "rank").orderBy("model", value, "predictor")


def model_bars(metrics: DataFrame, value: str, ascending: bool = True) -> DataFrame:
    """Bars comparing models on one metric, without models that lack it."""
    order = F.asc(value) if ascending else F.desc(value)
    return add_display_names(metrics.dropna(subset=[value])).select("model", "display_name", value).orderBy(order, "model")


def chosen_parameters(selected: DataFrame) -> DataFrame:
    """The chosen settings as a table: one row per family and parameter, from the settings' JSON text."""
    settings = F.from_json("parameters", "map<string,string>")
    rows = selected.select("model_family", "candidate_id", F.explode(settings).alias("parameter", "value"))
    return rows.orderBy("model_family", "parameter")


def complexity_report(complexity: DataFrame) -> DataFrame:
    """Model sizes with readable names: one row per model and measure that applies to it."""
    measures = [c for c in complexity.columns if c != "model"]
    doubles = complexity.select("model", *[F.col(c).cast("double").alias(c) for c in measures])
    long = doubles.unpivot(["model"], measures, "measure", "value").where("value is not null")
    return add_display_names(long).select("model", "display_name", "measure", "value").orderBy("model", "measure")
