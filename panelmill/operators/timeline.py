"""Row-order operators along an entity's history.

Histories have one row per entity and calendar period, so a window over one entity is
bounded by the calendar (36 years of days are about 13 thousand rows), however many
entities there are. For series without such a bound, :func:`history_blocks` cuts a
history into blocks of equal length with the overlap a frame needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelmill.functions.scalars import finite, month_number, positive, safe_ratio, shift_month_end
from panelmill.operators.relational import join_lead_period, without_keys


def pct_change(col: str, w: WindowSpec) -> Column:
    """Change from the previous row; missing values are not filled."""
    return F.try_divide(F.col(col), F.lag(col).over(w)) - 1


def growth_if_positive(col: str, w: WindowSpec) -> Column:
    """Change from the previous row, only from a positive base."""
    return F.col(col) / positive(F.lag(col).over(w)) - 1


def gap_aware_return(df: DataFrame, entity: str | None, month: str, price: str, out: str) -> DataFrame:
    """Period return, NULL unless the previous row is exactly the previous month end.

    Adds ``<out>_gap``: true where a calendar gap blocked the return. ``entity=None`` is for one
    period-grain series (market, rates), already aggregated to one row per month.
    """
    w = Window.partitionBy(entity).orderBy(month) if entity else Window.partitionBy(F.lit(0)).orderBy(month)
    before = F.lag(month).over(w)
    gap = before.isNotNull() & (F.col(month) != shift_month_end(before, 1))
    value = safe_ratio(F.col(price), F.lag(price).over(w)) - 1
    return df.select("*", F.when(~gap, value).alias(out), gap.alias(f"{out}_gap"))


def next_period_target(
    df: DataFrame, entity: str, month: str, ret: str, rates: DataFrame, rate: str, out: str
) -> DataFrame:
    """Next month's return less next month's rate.

    The lead counts only if the next row is exactly the next month end; ``<out>_gap`` marks rows
    where a gap blocked it.
    """
    w = Window.partitionBy(entity).orderBy(month)
    following = F.lead(month).over(w)
    exact = following == shift_month_end(month, 1)
    led = df.select(
        "*",
        F.when(exact, F.lead(ret).over(w)).alias("target_return_next_1m"),
        F.coalesce(~exact, F.lit(False)).alias(f"{out}_gap"),
    )
    renamed = rates.select(F.col(month), F.col(rate).alias("rf_next_1m"))
    joined = join_lead_period(led, renamed, month)
    return joined.withColumn(out, F.col("target_return_next_1m") - F.col("rf_next_1m"))


_FRAME_FUNCTIONS = {
    "mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min,
    "std": F.stddev_samp, "var": F.var_samp, "product": F.product,
}


def rolling(
    col: Column | str, fn: str, rows: int, w: WindowSpec, min_periods: int | None = None, skip: int = 0
) -> Column:
    """Statistic over the ``rows`` rows ending ``skip`` rows back; NULL below ``min_periods`` values.

    For frames of a few dozen rows. Long frames belong to :func:`rolling_pair_moments`.
    """
    c = F.col(col) if isinstance(col, str) else col
    frame = w.rowsBetween(-(rows - 1) - skip, -skip)
    need = rows if min_periods is None else min_periods
    return F.when(F.count(c).over(frame) >= need, _FRAME_FUNCTIONS[fn](c).over(frame))


def compounded_return(ret: str, rows: int, w: WindowSpec) -> Column:
    """Product of 1 + r over the previous ``rows`` rows, the current one excluded, less 1."""
    return rolling(F.col(ret) + 1, "product", rows, w, skip=1) - 1


def price_trends(df: DataFrame, entity: str, month: str) -> DataFrame:
    """Momentum, volatility level, trend and liquidity growth. One window, one sort."""
    w = Window.partitionBy(entity).orderBy(month)
    price = F.col("last_adj_close")
    return df.select(
        "*",
        compounded_return("ret_1m", 6, w).alias("mom6m"),
        compounded_return("ret_1m", 12, w).alias("mom12m"),
        compounded_return("ret_1m", 36, w).alias("long_term_return_36m"),
        rolling("retvol_1m", "mean", 12, w).alias("retvol12m"),
        growth_if_positive("avg_dolvol_1m", w).alias("dolvol_growth_1m"),
        safe_ratio(price, rolling(price, "mean", 12, w)).alias("price_to_ma12"),
        (safe_ratio(price, rolling(price, "max", 12, w)) - 1).alias("dist_from_high_12m"),
    )


def missing_periods(df: DataFrame, entity: str, month: str) -> DataFrame:
    """Whole months missing between a row and the one before."""
    w = Window.partitionBy(entity).orderBy(month)
    n = month_number(month)
    return df.withColumn("missing_months", n - F.lag(n).over(w) - 1)


def fragmented_entities(monthly: DataFrame, entity: str, month: str, max_missing: int) -> DataFrame:
    """Entities whose history has a hole of more than ``max_missing`` months."""
    gaps = missing_periods(monthly.select(entity, month).distinct(), entity, month)
    return gaps.groupBy(entity).agg(F.max("missing_months").alias("maximum_gap")).filter(F.col("maximum_gap") > max_missing)


def remove_fragmented(
    monthly: DataFrame, others: Sequence[DataFrame], entity: str, month: str, max_missing: int
) -> list[DataFrame]:
    """The monthly table and companion tables without the fragmented entities."""
    bad = fragmented_entities(monthly, entity, month, max_missing)
    return [without_keys(t, bad, [entity]) for t in (monthly, *others)]


def growth_over_spacing(
    df: DataFrame, entity: str, time: str, growths: dict[str, tuple[Column, Column, Column]], low: int, high: int
) -> DataFrame:
    """Growth columns ``(value - previous value) / base`` that count only if the rows are ``low`` to ``high`` days apart."""
    w = Window.partitionBy(entity).orderBy(time)
    spaced = F.datediff(F.col(time), F.lag(time).over(w)).between(low, high)
    out = [
        F.when(spaced, safe_ratio(value - F.lag(prev).over(w), F.lag(base).over(w))).alias(name)
        for name, (value, prev, base) in growths.items()
    ]
    return df.select("*", *out)


# --- long frames and long histories ---------------------------------------------
def history_positions(df: DataFrame, entity: str, time: str, piece: str = "year", ties: Sequence[str] = ()) -> DataFrame:
    """``__pos``: 0-based row position in the entity's history, without one task per entity.

    Rows are numbered inside calendar pieces; piece offsets come from a table with one row
    per entity and piece.
    """
    cut = df.withColumn("__piece", F.date_trunc(piece, F.col(time)))
    keys = [entity, "__piece"]
    sizes = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(entity).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(time, *ties))
    return (
        cut.withColumn("__inside", inside)
        .join(offsets, keys)
        .withColumn("__pos", F.col("__offset") + F.col("__inside") - 1)
        .drop("__inside", "__offset", "__piece")
    )


def history_blocks(positioned: DataFrame, overlap: int, block_rows: int) -> DataFrame:
    """Cut histories into blocks of ``block_rows`` rows.

    The last ``overlap`` rows of a block are repeated at the head of the next one (``__halo``),
    so that every frame of ``overlap`` earlier rows lies inside one block.
    """
    if block_rows < overlap:
        raise ValueError("a block must be at least as long as the overlap")
    home = F.floor(F.col("__pos") / block_rows)
    spills = (F.col("__pos") % block_rows) >= (block_rows - overlap)
    copies = F.when(spills, F.array(home, home + 1)).otherwise(F.array(home))
    return positioned.select("*", home.alias("__home"), F.explode(copies).alias("__block")).withColumn(
        "__halo", F.col("__block") != F.col("__home")
    ).drop("__home")


def rolling_pair_moments(
    df: DataFrame,
    entity: str,
    time: str,
    x: str,
    y: str,
    rows: int,
    min_periods: int,
    block_rows: int | None = None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Sample variances of x and y and their covariance over the last ``rows`` rows.

    Running sums differenced ``rows`` apart: linear in the rows, where a sliding frame would
    re-read ``rows`` values per row. Values are shifted by the first one of their window so
    that the differences keep their digits. ``block_rows`` splits long histories.
    Rows must hold both values.
    """
    if block_rows is None:
        data, part = df.withColumn("__halo", F.lit(False)), [entity]
        order = [time, *ties]
    else:
        data = history_blocks(history_positions(df, entity, time, ties=ties), rows - 1, block_rows)
        part, order = [entity, "__block"], ["__pos"]
    w = Window.partitionBy(*part).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    first = lambda c: F.first(c).over(run)
    shifted = data.select("*", (F.col(x) - first(x)).alias("__x"), (F.col(y) - first(y)).alias("__y"))
    terms = {
        "__n": F.lit(1.0), "__sx": F.col("__x"), "__sy": F.col("__y"), "__sxx": F.col("__x") * F.col("__x"),
        "__syy": F.col("__y") * F.col("__y"), "__sxy": F.col("__x") * F.col("__y"),
    }
    summed = shifted.select("*", *[F.sum(e).over(run).alias(k) for k, e in terms.items()])
    framed = summed.select(
        *[c for c in summed.columns if c not in terms],
        *[(F.col(k) - F.coalesce(F.lag(k, rows).over(w), F.lit(0.0))).alias(k) for k in terms],
    )
    n = F.col("__n")
    enough = (n >= min_periods) & (n > 1)

    def moment(cross: str, a: str, b: str) -> Column:
        return F.when(enough, (F.col(cross) - F.col(a) * F.col(b) / n) / (n - 1))

    return framed.filter(~F.col("__halo")).select(
        *df.columns,
        F.when(enough, F.greatest(moment("__sxx", "__sx", "__sx"), F.lit(0.0))).alias(f"var_{x}"),
        F.when(enough, F.greatest(moment("__syy", "__sy", "__sy"), F.lit(0.0))).alias(f"var_{y}"),
        moment("__sxy", "__sx", "__sy").alias("cov"),
    )


def rolling_beta(
    returns: DataFrame,
    entity: str,
    time: str,
    ret: str,
    market_ret: str,
    rows: int = 252,
    min_periods: int = 126,
    block_rows: int | None = None,
) -> DataFrame:
    """Beta, its square and idiosyncratic volatility over a trailing frame."""
    m = rolling_pair_moments(returns, entity, time, ret, market_ret, rows, min_periods, block_rows)
    raw = F.try_divide(F.col("cov"), F.col(f"var_{market_ret}"))
    residual = F.col(f"var_{ret}") - raw * raw * F.col(f"var_{market_ret}")
    return m.select(
        *returns.columns,
        finite(raw).alias("beta_12m"),
        finite(raw * raw).alias("betasq_12m"),
        F.when(residual.isNotNull(), F.sqrt(F.greatest(residual, F.lit(0.0)))).alias("idiovol_12m"),
    )
