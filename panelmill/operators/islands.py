"""Runs of equal values and calendar continuity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions.scalars import any_null


def value_runs(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """Consecutive rows with an equal value: (keys, run, value, start, end, length).

    A NULL differs from everything, also from another NULL. One row per key and period expected.
    """
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(time)
    changed = F.coalesce(F.col(value) != F.lag(value).over(w), F.lit(True))
    marked = df.select(*keys, time, value, changed.cast("long").alias("__new"))
    numbered = marked.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "run").agg(
        F.max(value).alias("value"), F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("length")
    )


def longest_run(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """Longest run per key; the earliest one on ties."""
    runs = value_runs(df, keys, time, value)
    best = runs.groupBy(*keys).agg(
        F.min_by(F.struct("value", "start", "end", "length"), F.struct(-F.col("length"), F.col("start"))).alias("__r")
    )
    return best.select(*keys, "__r.*")


def month_sequence_gaps(df: DataFrame, month: str) -> DataFrame:
    """Month ends absent between the first and last one: the series is continuous if there are none."""
    ends = df.agg(F.min(month).alias("a"), F.max(month).alias("b"))
    count = F.floor(F.months_between("b", "a")).cast("int")
    steps = ends.select(F.explode(F.sequence(F.lit(0), count)).alias("k"), "a")
    expected = steps.select(F.last_day(F.expr("add_months(a, k)")).alias(month))
    return expected.join(df.select(month), month, "left_anti")


def lagged_coverage(df: DataFrame, month: str, cols: Sequence[str]) -> DataFrame:
    """Months after the first one in which a lagged dimension is missing, with row counts."""
    bad = df.filter(any_null(cols) & (F.col(month) > df.agg(F.min(month)).scalar()))
    return bad.groupBy(month).agg(F.count(F.lit(1)).alias("rows"))

