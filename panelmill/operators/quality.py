"""Data contracts: many checks answered by one aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.operators.relational import one_row_per


class Check:
    """A named check; ``failures`` is an aggregate that counts violations."""

    def __init__(self, name: str, failures: Column):
        self.name, self.failures = name, failures


def _count_true(flags: Sequence[str]) -> Column:
    """How many of the flags (never NULL) hold, summed over rows: one aggregate however many columns there are. A lambda would have all of them interpreted, not compiled."""
    return F.expr(f"coalesce(sum(size(array_remove(array({', '.join(flags)}), false))), 0)")


def no_nulls(cols: Sequence[str], name: str = "null_values") -> Check:
    return Check(name, _count_true([f"`{c}` IS NULL" for c in cols]))


def no_infinities(cols: Sequence[str], name: str = "infinite_values") -> Check:
    return Check(name, _count_true([f"abs(cast(`{c}` AS double)) <=> double('inf')" for c in cols]))


def never(condition: Column, name: str) -> Check:
    """Rows on which ``condition`` holds are violations."""
    return Check(name, F.count_if(condition))


def expect(df: DataFrame, checks: Sequence[Check], unique: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Rows (check, failures, ok). ``strict`` raises on the first violated check.

    With ``unique`` the surplus rows of repeated keys are counted too; both parts combine map-side.
    """
    parts = []
    if checks:
        one = df.agg(*[c.failures.cast("long").alias(c.name) for c in checks])
        parts.append(one.unpivot([], [c.name for c in checks], "check", "failures"))
    if unique:
        sizes = df.groupBy(*unique).agg((F.count(F.lit(1)) - 1).alias("__surplus"))
        surplus = F.coalesce(F.sum("__surplus"), F.lit(0)).cast("long")
        parts.append(sizes.agg(F.lit("duplicate_keys").alias("check"), surplus.alias("failures")))
    long = reduce(DataFrame.unionByName, parts).withColumn("ok", F.col("failures") == 0)
    if strict:
        bad = long.filter(~F.col("ok")).collect()  # at most one row per check
        if bad:
            raise ValueError("failed checks: " + ", ".join(f"{r.check}={r.failures}" for r in bad))
    return long


def constant_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns with at most one distinct value."""
    spread = df.agg(*[(F.min(c).eqNullSafe(F.max(c))).alias(c) for c in cols])
    return spread.unpivot([], list(cols), "column", "constant").filter("constant").select("column")


def table_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], cols: Sequence[str], tolerance: float) -> DataFrame:
    """Largest absolute difference per column over the joined keys, plus keys on one side only."""
    a = left.select(*keys, *[F.col(c).alias(f"l_{c}") for c in cols], F.lit(1).alias("__a"))
    b = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in cols], F.lit(1).alias("__b"))
    both = a.join(b, list(keys), "full")
    stats = []
    for c in cols:
        matched = F.col("__a").isNotNull() & F.col("__b").isNotNull()
        one_null = matched & (F.col(f"l_{c}").isNull() != F.col(f"r_{c}").isNull())
        stats.append(
            F.struct(
                F.lit(c).alias("column"),
                F.coalesce(F.max(F.abs(F.col(f"l_{c}") - F.col(f"r_{c}"))), F.lit(0.0)).alias("max_abs_diff"),
                F.count_if(one_null).alias("null_mismatches"),
                F.count_if(F.col("__a").isNull() | F.col("__b").isNull()).alias("unmatched_keys"),
            )
        )
    rows = both.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    ok = (F.col("max_abs_diff") <= tolerance) & (F.col("null_mismatches") == 0) & (F.col("unmatched_keys") == 0)
    return rows.withColumn("ok", ok)


def key_value_summary(df: DataFrame, items: dict[str, Column]) -> DataFrame:
    """One row per summary item, value as text, from a single aggregate."""
    one = df.agg(*[e.cast("string").alias(k) for k, e in items.items()])
    return one.unpivot([], list(items), "item", "value")


def load_report(loaded: DataFrame, universe: DataFrame, entity: str, date: str, missing_columns: DataFrame | None = None) -> DataFrame:
    """Per expected entity: status, reason, row count and date range of what arrived.

    ``missing_columns``: (entity, missing_columns) with the absent columns' names, for entities that lack some.
    """
    arrived = loaded.groupBy(entity).agg(
        F.count(F.lit(1)).alias("rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date")
    )
    joined = universe.select(entity).distinct().join(arrived, entity, "left")
    if missing_columns is None:
        joined = joined.withColumn("missing_columns", F.lit(None).cast("string"))
    else:
        joined = joined.join(one_row_per(missing_columns.select(entity, "missing_columns"), entity), entity, "left")
    lacking = F.coalesce("missing_columns", F.lit("")) != ""
    reason = F.when(lacking, F.concat(F.lit("missing_columns:"), "missing_columns")).when(F.col("rows").isNull(), "no_data").otherwise("")
    return joined.select(
        entity,
        F.when(reason == "", "downloaded").otherwise("failed").alias("status"),
        reason.alias("reason"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
        "first_date",
        "last_date",
    )
