"""Cross-sectional preparation: imputation, winsorisation, dummies, interactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.functions import names
from panelmill.functions.scalars import to_double
from panelmill.operators.quantiles import group_clip_bounds
from panelmill.operators.relational import calendar_side
from panelmill.session import cut_lineage


def impute_and_winsorize(
    df: DataFrame,
    period: str,
    cols: Sequence[str],
    lower: float = names.WINSOR_LOWER,
    upper: float = names.WINSOR_UPPER,
    winsorize: bool = True,
    is_stored: bool = False,
) -> DataFrame:
    """Fill NULLs with the period median (0 if the period has none), then clip to period quantiles.

    The bounds are those of the filled sample. They come as one row per period with an array over features; with DATE
    periods that table is broadcast, so no wide row is shuffled. The input is read several times: it is stored
    first unless ``is_stored``.
    """
    cols = list(cols)
    df = df if is_stored else cut_lineage(df)
    bounds = group_clip_bounds(df, [period], cols, lower, upper, is_stored=True)
    position = F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("feature"))
    per_period = cut_lineage(
        bounds.groupBy(period).agg(
            F.sort_array(F.collect_list(F.struct(position.alias("i"), "median", "lower", "upper"))).alias("__bounds")  # len(cols) entries
        )
    )
    dim = calendar_side(per_period.withColumnRenamed(period, "__period"), "__period")
    joined = df.join(dim, F.col(period).eqNullSafe(F.col("__period")), "left")

    # Wide projections are written as SQL text: one call for all columns instead of a dozen per column.
    def cleaned(c: str) -> str:
        b = f"__bounds[{cols.index(c)}]"
        filled = f"coalesce(cast(`{c}` AS double), {b}.median, 0.0D)"
        clipped = f"CASE WHEN {filled} < {b}.lower THEN {b}.lower WHEN {filled} > {b}.upper THEN {b}.upper ELSE {filled} END"
        return f"{clipped if winsorize else filled} AS `{c}`"

    return joined.selectExpr(*[cleaned(c) if c in cols else f"`{c}`" for c in df.columns])


def fill_flags(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Binary columns: missing is 0, stored as a byte."""
    return df.selectExpr(*[f"cast(coalesce(`{c}`, 0) AS byte) AS `{c}`" if c in cols else f"`{c}`" for c in df.columns])


def code_values(df: DataFrame, code: str) -> list[int]:
    """Sorted distinct codes (no number: -1). Each becomes a column of the plan, so all of them have to be known before it is built."""
    c = F.coalesce(to_double(code).cast("int"), F.lit(-1))
    return sorted(r.v for r in df.select(c.alias("v")).distinct().collect())


def one_hot(df: DataFrame, code: str, prefix: str, values: Sequence[int] | None = None) -> tuple[DataFrame, list[str]]:
    """One byte column per code value; codes that are no number go to ``<prefix>_missing``."""
    values = code_values(df, code) if values is None else list(values)
    labels = [f"{prefix}_missing" if v == -1 else f"{prefix}_{v}" for v in values]
    coded = df.withColumn("__code", F.coalesce(to_double(code).cast("int"), F.lit(-1)))
    dummies = [f"cast(__code = {v} AS byte) AS `{n}`" for v, n in zip(values, labels)]
    return coded.selectExpr(*[f"`{c}`" for c in df.columns], *dummies), labels


def interactions(df: DataFrame, cols: Sequence[str], states: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Products ``<col>_x_<state>``, state-major, in a single projection."""
    pairs = [(c, s) for s in states for c in cols]
    out = df.selectExpr("*", *[f"`{c}` * `{s}` AS `{c}_x_{s}`" for c, s in pairs])
    return out, [f"{c}_x_{s}" for c, s in pairs]


def as_vector(df: DataFrame, predictors: Sequence[str], out: str = "features") -> DataFrame:
    """Predictors in contract order as one array of floats, the form the linear fits read."""
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in predictors]).cast("array<float>"))
