"""Tables about tree ensembles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def oob_metrics(oob: DataFrame, month: str, label: str) -> DataFrame:
    """Pooled and month-weighted OOB error and R2 over rows that have an OOB forecast."""
    rows = oob.filter(F.col("oob_prediction").isNotNull())
    e = F.col(label) - F.col("oob_prediction")
    per = rows.groupBy(month).agg(
        F.avg(e * e).alias("m"), F.sum(e * e).alias("s"), F.count(F.lit(1)).alias("n"), F.avg(label).alias("a"), F.var_pop(label).alias("v")
    )
    n = F.sum("n")
    sst = F.sum(F.col("n") * (F.col("v") + F.col("a") * F.col("a"))) - F.pow(F.sum(F.col("n") * F.col("a")), 2) / n
    return per.agg(
        n.alias("oob_rows"),
        (F.sum("s") / n).alias("oob_pooled_mse"),
        F.avg("m").alias("oob_monthly_mse"),
        (1 - F.try_divide(F.sum("s"), sst)).alias("oob_r2"),
    )


def importance_rows(spark: SparkSession, importances: dict[str, Sequence[float]], predictors: Sequence[str]) -> DataFrame:
    rows = [(m, i, c, float(v)) for m, values in importances.items() for i, (c, v) in enumerate(zip(predictors, values))]
    return spark.createDataFrame(rows, "model string, ordinal int, predictor string, impurity_importance double")


def complexity_rows(spark: SparkSession, models: dict[str, dict]) -> DataFrame:
    """Model-size summary; absent entries are NULL."""
    columns = {
        "number_of_predictors": "int", "nonzero_coefficients": "int", "nonzero_share": "double", "pls_components": "int",
        "trees": "int", "learning_rate": "double", "maximum_depth_setting": "int", "average_tree_depth": "double",
        "maximum_tree_depth": "int", "average_tree_leaves": "double",
    }
    rows = [(m, *[v.get(c) for c in columns]) for m, v in models.items()]
    return spark.createDataFrame(rows, "model string, " + ", ".join(f"{c} {t}" for c, t in columns.items()))
