"""Forecast evaluation on the long prediction table.

A prediction row has group columns (model, sample, ...), entity, month, the realised value,
the forecast and the benchmark forecast. Months are aggregated first, then the groups: every
step is a mergeable aggregate, so a hot month or model is combined before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions import names
from panelmill.operators.quantiles import group_quantiles
from panelmill.operators.relational import attach_benchmark, top_per_group
from panelmill.session import cut_lineage


def monthly_mse(predictions: DataFrame, keys: Sequence[str], month: str, actual: str, forecast: str) -> DataFrame:
    """Mean over months of the month's mean squared error: every month counts the same."""
    error = F.col(actual) - F.col(forecast)
    per_month = predictions.groupBy(*keys, month).agg(F.avg(error * error).alias("__mse"))
    return per_month.groupBy(*keys).agg(F.avg("__mse").alias("monthly_mse"))


def forecast_metrics(
    predictions: DataFrame,
    keys: Sequence[str],
    month: str = "month",
    actual: str = "realized_target",
    forecast: str = "prediction",
    benchmark: str = "benchmark",
) -> DataFrame:
    """Pooled and month-weighted errors, out-of-sample R2, correlation and forecast moments per group.

    One scan. Means, variances and the covariance are carried per month and merged, which keeps
    more digits than raw sums of squares.
    """
    y, p = F.col(actual), F.col(forecast)
    e, eb = y - p, y - F.col(benchmark)
    per_month = predictions.groupBy(*keys, month).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(e * e).alias("sse"),
        F.sum(eb * eb).alias("sse_b"),
        F.sum(F.abs(e)).alias("sae"),
        F.avg(y).alias("my"),
        F.avg(p).alias("mp"),
        F.var_pop(y).alias("vy"),
        F.var_pop(p).alias("vp"),
        F.covar_pop(y, p).alias("cyp"),
    )
    n, my, mp = F.col("n"), F.col("my"), F.col("mp")
    groups = per_month.groupBy(*keys).agg(
        F.sum("n").alias("observations"),
        F.count(F.lit(1)).alias("months"),
        F.sum("sse").alias("__sse"),
        F.sum("sse_b").alias("__sse_b"),
        F.sum("sae").alias("__sae"),
        F.avg(F.col("sse") / n).alias("monthly_mse"),
        F.avg(F.col("sse_b") / n).alias("__monthly_b"),
        (F.sum(n * my) / F.sum("n")).alias("__my"),
        (F.sum(n * mp) / F.sum("n")).alias("prediction_mean"),
        (F.sum(n * (F.col("vy") + my * my)) / F.sum("n")).alias("__yy"),
        (F.sum(n * (F.col("vp") + mp * mp)) / F.sum("n")).alias("__pp"),
        (F.sum(n * (F.col("cyp") + my * mp)) / F.sum("n")).alias("__yp"),
    )
    size = F.col("observations")
    var_y = F.greatest(F.col("__yy") - F.col("__my") * F.col("__my"), F.lit(0.0))
    var_p = F.greatest(F.col("__pp") - F.col("prediction_mean") * F.col("prediction_mean"), F.lit(0.0))
    cov = F.col("__yp") - F.col("__my") * F.col("prediction_mean")
    std_p = F.sqrt(var_p)
    return groups.select(
        *keys,
        "observations",
        "months",
        (F.col("__sse") / size).alias("pooled_mse"),
        F.sqrt(F.col("__sse") / size).alias("pooled_rmse"),
        (F.col("__sae") / size).alias("pooled_mae"),
        "monthly_mse",
        F.sqrt("monthly_mse").alias("monthly_rmse"),
        (1 - F.col("__sse") / F.when(F.col("__sse_b") > 0, F.col("__sse_b"))).alias("oos_r2"),
        (1 - F.col("monthly_mse") / F.when(F.col("__monthly_b") > 0, F.col("__monthly_b"))).alias("monthly_oos_r2"),
        F.when(std_p > names.CONSTANT_STD, F.try_divide(cov, std_p * F.sqrt(var_y))).alias("prediction_target_correlation"),
        "prediction_mean",
        std_p.alias("prediction_std"),
    )


def historical_mean_benchmark(df: DataFrame, estimation: DataFrame, target: str, out: str = "benchmark") -> DataFrame:
    """Mean target of the estimation sample as a constant forecast (a scalar subquery)."""
    return df.withColumn(out, estimation.agg(F.avg(target)).scalar())


def yearly_metrics(
    predictions: DataFrame,
    benchmark_model: str = names.BENCHMARK_MODEL,
    entity: str = "entity",
    month: str = "month",
    strict: bool = False,
) -> DataFrame:
    """Metrics per model and year against the benchmark model's own forecasts."""
    with_b = attach_benchmark(predictions, benchmark_model, [entity, month])
    if strict and with_b.filter(F.col("benchmark").isNull()).limit(1).count():
        raise ValueError("benchmark predictions are incomplete")
    return forecast_metrics(with_b.withColumn("year", F.year(month)), ["model", "year"], month)


def yearly_stability(yearly: DataFrame, tolerance: float = names.R2_TOLERANCE) -> DataFrame:
    """How a model's yearly results vary."""
    return yearly.groupBy("model").agg(
        F.avg("monthly_mse").alias("yearly_mean_mse"),
        F.stddev_samp("monthly_mse").alias("yearly_mse_std"),
        F.avg("monthly_oos_r2").alias("yearly_mean_monthly_oos_r2"),
        F.stddev_samp("monthly_oos_r2").alias("yearly_monthly_oos_r2_std"),
        F.avg("oos_r2").alias("yearly_mean_pooled_oos_r2"),
        F.avg(F.coalesce(F.col("monthly_oos_r2") > tolerance, F.lit(False)).cast("double")).alias(
            "positive_monthly_oos_r2_year_share"
        ),
        F.count("year").alias("number_of_years_evaluated"),
    )


def best_and_worst_year(yearly: DataFrame) -> DataFrame:
    """Year with the smallest and with the largest monthly MSE per model; the earliest on ties."""
    row = F.struct("year", "monthly_mse", "monthly_oos_r2", "oos_r2")
    picked = yearly.groupBy("model").agg(
        F.min_by(row, F.struct("monthly_mse", "year")).alias("b"),
        F.max_by(row, F.struct(F.col("monthly_mse"), -F.col("year"))).alias("w"),
    )
    return picked.select(
        "model",
        *[
            F.col(f"{s}.{c}").alias(f"{label}_test_year{suffix}")
            for s, label in (("b", "best"), ("w", "worst"))
            for c, suffix in (("year", ""), ("monthly_mse", "_mse"), ("monthly_oos_r2", "_monthly_oos_r2"), ("oos_r2", "_pooled_oos_r2"))
        ],
    )


def rank_models(metrics: DataFrame, sample: str | None = None) -> DataFrame:
    """Rank by month-weighted MSE, then pooled RMSE, then MAE. One row per model, hence one small window."""
    rows = metrics.filter(F.col("sample") == sample) if sample is not None else metrics
    w = Window.partitionBy(F.lit(0)).orderBy("monthly_mse", "pooled_rmse", "pooled_mae", "model")
    return rows.select(F.row_number().over(w).alias("rank"), "*")


def distribution_summary(
    df: DataFrame, keys: Sequence[str], value: str, distinct: dict[str, str], is_stored: bool = False
) -> DataFrame:
    """Moments, exact 1/50/99 % quantiles and exact distinct counts per group.

    ``distinct`` maps output names to counted columns. Distinct counts are a two-step aggregate over
    (group, column, value), so no group's values meet in one task. The needed columns are stored first unless ``is_stored``.
    """
    if not keys:
        whole = distribution_summary(df.withColumn("__all", F.lit(0)), ["__all"], value, distinct)
        return whole.drop("__all")
    keys = list(keys)
    if keys != ["__group"]:
        # One struct as key: unlike plain columns it is equal to itself in a join when a field is NULL.
        named = df.select(F.struct(*keys).alias("__group"), *[F.col(c) for c in dict.fromkeys([value, *distinct.values()])])
        return distribution_summary(named, ["__group"], value, distinct).select(*[F.col("__group")[k].alias(k) for k in keys], F.expr("* except (__group)"))
    if not is_stored:
        df = cut_lineage(df.select(*dict.fromkeys([*keys, value, *distinct.values()])))
    moments = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observations"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("minimum"),
        F.max(value).alias("maximum"),
    )
    q = group_quantiles(df, keys, [value], [0.01, 0.5, 0.99], is_stored=True).select(
        *keys, F.col("q0").alias("p01"), F.col("q1").alias("median"), F.col("q2").alias("p99")
    )
    out = moments.join(q, keys)
    if distinct:
        # All columns in one pair of aggregates: first the distinct values, then their number. A NULL keeps the group but is no value.
        entries = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(distinct.values())])
        values = df.select(*keys, F.explode(entries).alias("__e")).select(*keys, "__e.i", "__e.v").distinct()
        out = out.join(values.groupBy(*keys).agg(*[F.count(F.when(F.col("i") == i, F.col("v"))).alias(name) for i, name in enumerate(distinct)]), keys)
    return out


def extreme_predictions(predictions: DataFrame, keys: Sequence[str], ties: Sequence[str], n: int = 25) -> DataFrame:
    """The n largest forecasts in absolute size per group; ``ties`` fixes the order of equal ones."""
    sized = predictions.withColumn("absolute_prediction", F.abs("prediction"))
    return top_per_group(sized, keys, [F.desc("absolute_prediction"), *[F.asc(t) for t in ties]], n)


def model_interpretation(metrics: DataFrame, predictions: DataFrame, yearly: DataFrame, sample: str = "test") -> DataFrame:
    """One row per model: rank, metrics, realised moments, bias, yearly stability, best and worst year.

    Every joined table has one row per model. A ranked model without predictions in ``sample`` is an error.
    """
    own = predictions.filter(F.col("sample") == sample) if "sample" in predictions.columns else predictions
    realised = own.groupBy("model").agg(
        F.avg("realized_target").alias("realized_mean"), F.stddev_samp("realized_target").alias("realized_std"), F.lit(True).alias("__seen")
    )
    ranked = rank_models(metrics, sample).withColumnsRenamed(
        {"pooled_rmse": "rmse", "pooled_mae": "mae", "prediction_target_correlation": "correlation"}
    )
    out = ranked
    for part in (realised, yearly_stability(yearly), best_and_worst_year(yearly)):
        out = out.join(part, "model", "left")
    absent = F.raise_error(F.concat(F.lit(f"no predictions of sample {sample} for model "), "model")).cast("double")
    mean = F.when(F.col("__seen").isNull(), absent).otherwise(F.col("realized_mean"))
    return out.withColumn("realized_mean", mean).withColumn("prediction_bias", F.col("prediction_mean") - F.col("realized_mean")).drop("__seen")


def behaviour_flags(interpretation: DataFrame, benchmark_model: str = names.BENCHMARK_MODEL) -> DataFrame:
    """True/false statements on each model's forecasts."""
    every = Window.partitionBy(F.lit(0))  # one row per model
    rows = interpretation.select(
        "*",
        F.max(F.when(F.col("model") == benchmark_model, F.col("monthly_mse"))).over(every).alias("__mse"),
        F.min_by("model", "rank").over(every).alias("__best"),
        F.max_by("model", "rank").over(every).alias("__worst"),
    )

    def above(c: str) -> Column:
        return F.coalesce(F.col(c) > names.R2_TOLERANCE, F.lit(False))

    return rows.select(
        "model",
        (F.col("monthly_mse") < F.col("__mse")).alias("beats_historical_mean"),
        above("monthly_oos_r2").alias("positive_monthly_oos_r2"),
        above("oos_r2").alias("positive_pooled_oos_r2"),
        (F.col("prediction_std") <= names.CONSTANT_STD).alias("constant_or_near_constant_predictions"),
        (F.col("positive_monthly_oos_r2_year_share") >= names.POSITIVE_YEAR_SHARE).alias("positive_in_most_test_years"),
        (F.col("model") == F.col("__best")).alias("best_prediction_model"),
        (F.col("model") == F.col("__worst")).alias("worst_prediction_model"),
        F.lit(names.CONSTANT_STD).alias("near_constant_std_threshold"),
        F.lit(names.R2_TOLERANCE).alias("oos_r2_tolerance"),
        F.lit(names.POSITIVE_YEAR_SHARE).alias("positive_year_share_threshold"),
    )
