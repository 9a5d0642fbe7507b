"""Daily bars: quality flags, one row per entity and day, entity report, removal."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions import names
from panelmill.functions.scalars import any_nonpositive, any_null
from panelmill.operators.relational import without_keys
from panelmill.operators.timeline import pct_change


def drop_repeats(bars: DataFrame, entity: str, time: str, order: Sequence[str]) -> DataFrame:
    """Last row per entity and day under ``order``, with the day's number of dropped rows.

    Pick and count are one aggregate, combined map-side, so the rows are read once and an entity or day with very many
    copies is no hot spot. Rows without an entity or day are groups like any other.
    """
    keys = [entity, time]
    values = [c for c in bars.columns if c not in keys]
    last = F.max_by(F.struct(*values), F.struct(*order)) if values else F.lit(None)
    picked = bars.groupBy(*keys).agg(last.alias("__last"), (F.count(F.lit(1)) - 1).alias("dropped_rows"))
    return picked.select(*keys, *[F.col("__last")[c].alias(c) for c in values], "dropped_rows")


def flag_bars(
    bars: DataFrame,
    entity: str,
    time: str,
    high_return: float = names.EXTREME_RETURN_HIGH,
    low_return: float = names.EXTREME_RETURN_LOW,
) -> DataFrame:
    """Quality flags per row. Input: one row per entity and day.

    The day key bounds an entity's rows by the calendar, so the one window is small.
    """
    w = Window.partitionBy(entity).orderBy(time)
    before = F.lag("adj_close").over(w)
    high, low = F.col("high"), F.col("low")
    breaks = [high < low, high < F.col("open"), high < F.col("close"), low > F.col("open"), low > F.col("close")]
    # A comparison with a missing price is not a violation.
    bad_ohlc = reduce(lambda x, y: x | y, [F.coalesce(b, F.lit(False)) for b in breaks])
    # A previous price of zero makes the return infinite (or undefined for 0 to 0): flagged by sign.
    from_zero = (before == 0) & (F.col("adj_close") != 0)
    flagged = bars.select(
        "*",
        pct_change("adj_close", w).alias("daily_ret"),
        F.coalesce(from_zero, F.lit(False)).alias("__jump"),
        bad_ohlc.alias("bad_ohlc"),
        any_null([*names.PRICE_COLUMNS, "volume"]).alias("missing_core"),
        any_nonpositive(names.PRICE_COLUMNS).alias("nonpositive_price"),
    )
    extreme = (F.col("daily_ret") > high_return) | (F.col("daily_ret") < low_return)
    return flagged.select(
        *[c for c in flagged.columns if c != "__jump"],
        (F.coalesce(extreme, F.lit(False)) | F.col("__jump")).alias("extreme_return"),
        (F.col("bad_ohlc") | F.col("missing_core") | F.col("nonpositive_price")).alias("bad_row"),
    )


def quality_report(flagged: DataFrame, entity: str, time: str, bad_share: float = names.BAD_ROW_SHARE) -> DataFrame:
    """Counts, range and the keep-or-remove decision per entity."""
    report = flagged.groupBy(entity).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(time).alias("first_date"),
        F.max(time).alias("last_date"),
        *[F.count_if(flag).alias(f"{flag}_rows") for flag in ("bad_ohlc", "missing_core", "nonpositive_price", "extreme_return")],
        F.count_if("bad_row").alias("bad_rows"),
        F.min("daily_ret").alias("minimum_daily_return"),
        F.max("daily_ret").alias("maximum_daily_return"),
        F.sum("dropped_rows").alias("duplicate_rows"),
    )
    share = F.col("bad_rows") / F.col("rows")
    too_bad, extreme = share > bad_share, F.col("extreme_return_rows") > 0
    return report.select(
        "*",
        share.alias("bad_row_share"),
        (too_bad | extreme).alias("remove_entity"),
        F.when(too_bad | extreme, "removed_quality").otherwise("retained").alias("status"),
        F.when(too_bad & extreme, "bad_row_share_and_extreme_return")
        .when(too_bad, "bad_row_share_above_threshold")
        .when(extreme, "extreme_adjusted_return")
        .otherwise("")
        .alias("removal_reason"),
    )


def clean_bars(flagged: DataFrame, report: DataFrame, entity: str, columns: Sequence[str]) -> DataFrame:
    """Good rows of retained entities."""
    good = flagged.filter(~F.col("bad_row")).select(*columns)
    return without_keys(good, report.filter("remove_entity"), [entity])
