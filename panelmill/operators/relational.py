"""Keys, joins and set operations.

Join policy: a side is broadcast only when its row count is bounded by construction (one row per calendar month or
day); every other join is left to adaptive execution, which measures sizes and splits skewed partitions at run time.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from panelmill.functions.scalars import shift_month_end


# --- guards ------------------------------------------------------------------
def require_columns(df: DataFrame, names: Sequence[str], label: str = "table") -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{label} is missing columns: {missing}")
    repeated = sorted({n for n in names if list(names).count(n) > 1})
    if repeated:
        raise ValueError(f"{label}: repeated columns: {repeated}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def require_unique(df: DataFrame, keys: Sequence[str], label: str = "table") -> DataFrame:
    if duplicate_keys(df, keys).limit(1).count():
        raise ValueError(f"{label}: duplicate rows for {list(keys)}")
    return df


def select_contract(df: DataFrame, keys: Sequence[str], predictors: Sequence[str]) -> DataFrame:
    """Exactly the contracted columns, in contract order."""
    names = [*keys, *predictors]
    return require_columns(df, names, "model table").select(*names)


# --- filters -----------------------------------------------------------------
def equal_where_present(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Conjunction of equality filters; a filter on an absent column is skipped."""
    tests = [F.col(k) == F.lit(v) for k, v in wanted.items() if k in df.columns]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def split_by_time(df: DataFrame, time: str, train_end: str, validation_end: str) -> dict[str, DataFrame]:
    """Chronological samples as filters on the time column. They overlap on purpose:
    development holds train and validation."""
    t, a, b = F.col(time), F.lit(train_end).cast("date"), F.lit(validation_end).cast("date")
    return {
        "train": df.filter(t <= a),
        "validation": df.filter((t > a) & (t <= b)),
        "development": df.filter(t <= b),
        "test": df.filter(t > b),
    }


def drop_first_period(df: DataFrame, time: str) -> DataFrame:
    """Rows after the earliest period; the minimum is a scalar subquery."""
    return df.filter(F.col(time) > df.agg(F.min(time)).scalar())


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last under ``order``, which must break every tie.

    ``row_number() == 1`` makes Spark prune to one row per key in each input partition
    before the shuffle, so a hot key costs no more than the others.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per group with their ``rank``; pruned before the shuffle like :func:`keep_last`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def stable_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in an order fixed by the MD5 of seed and keys, written as ``seed|key|...``, whatever the partitioning."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys])), *keys).limit(n)


# --- joins -------------------------------------------------------------------
def calendar_side(dim: DataFrame, time: str) -> DataFrame:
    """Hint a broadcast of a table with one row per DATE, which the calendar bounds; other keys are left to adaptive execution."""
    return F.broadcast(dim) if isinstance(dim.schema[time].dataType, DateType) else dim


def one_row_per(dim: DataFrame, key: str) -> DataFrame:
    """The table itself, which fails when it is read if a key has two rows."""
    values = [c for c in dim.columns if c != key]
    several = F.concat(F.lit(f"two rows for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))
    checked = [F.when(F.count(F.lit(1)) > 1, F.raise_error(several).cast(dim.schema[c].dataType)).otherwise(F.any_value(c)).alias(c) for c in values]
    return dim.groupBy(key).agg(*checked) if values else dim.distinct()


def join_period(df: DataFrame, dim: DataFrame, time: str) -> DataFrame:
    """Left join of a month-grain dimension.

    Two rows for a period are an error, so the row count of ``df`` stays and no row is made up of two.
    """
    return df.join(calendar_side(one_row_per(dim, time), time), time, "left")


def join_lagged_period(df: DataFrame, dim: DataFrame, time: str, source_time: str, months: int = 1) -> DataFrame:
    """Period t sees the dimension of period t - ``months``."""
    moved = dim.withColumn(time, shift_month_end(source_time, months))
    if source_time != time:
        moved = moved.drop(source_time)
    return join_period(df, moved, time)


def join_lead_period(df: DataFrame, dim: DataFrame, time: str, months: int = 1) -> DataFrame:
    """Period t sees the dimension of period t + ``months``."""
    return join_lagged_period(df, dim, time, time, -months)


def join_checked(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", validate: str = "many_to_one"
) -> DataFrame:
    """Join that first proves the declared key uniqueness of its sides."""
    if validate not in ("many_to_one", "one_to_one"):
        raise ValueError(f"unknown validation {validate}")
    require_unique(right, on, "right side")
    if validate == "one_to_one":
        require_unique(left, on, "left side")
    return left.join(right, list(on), how)


def without_keys(df: DataFrame, removed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(removed.select(*keys), list(keys), "left_anti")


def with_keys(df: DataFrame, kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(kept.select(*keys), list(keys), "left_semi")


def lookup(df: DataFrame, table: DataFrame, on: Sequence[str], value: str, default) -> DataFrame:
    """Mapped value with a default for absent keys."""
    joined = df.join(table.select(*on, value), list(on), "left")
    return joined.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def attach_benchmark(
    predictions: DataFrame, benchmark_model: str, keys: Sequence[str], model: str = "model", value: str = "prediction"
) -> DataFrame:
    """Benchmark model's forecast on every row with the same keys, without a self-join.

    One model writes one row per key, so a group holds as many rows as there are models.
    """
    w = Window.partitionBy(*keys)
    return predictions.withColumn("benchmark", F.max(F.when(F.col(model) == benchmark_model, F.col(value))).over(w))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    split: str | None = None,
) -> DataFrame:
    """Backward as-of join: each left row gets the latest right row at or before its time.

    Both sides are shuffled once by key, sorted by time, and the last right row is carried
    forward, which is linear in the rows of a key (an interval join compares pairs).
    ``right`` must have one row per key and time.

    ``split`` (``"year"`` or ``"month"``) cuts every key into calendar pieces that are solved apart;
    what a piece inherits from earlier ones is found on one row per piece. Use it when a
    single key may hold a large share of the rows.
    """
    keys = list(keys)
    values = [c for c in right.columns if c not in keys]
    lefts = left.columns
    packed = F.struct(*[F.col(c) for c in values])

    def carry(l_df: DataFrame, r_df: DataFrame, by: list[str], l_time: str, inclusive: bool) -> DataFrame:
        """Last ``__r`` up to (or strictly before) each left row, within ``by``."""
        l_cols = l_df.columns
        kind = r_df.schema["__r"].dataType
        a = l_df.withColumn("__t", F.col(l_time)).withColumn("__r", F.lit(None).cast(kind))
        a = a.withColumn("__o", F.lit(1 if inclusive else 0))
        b = r_df.withColumn("__o", F.lit(0 if inclusive else 1))
        w = Window.partitionBy(*by).orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, 0)
        both = a.unionByName(b, allowMissingColumns=True)
        found = both.withColumn("__m", F.last("__r", ignorenulls=True).over(w))
        return found.filter(F.col("__o") == (1 if inclusive else 0)).select(*l_cols, "__m")

    r = right.select(*keys, F.col(right_time).alias("__t"), packed.alias("__r"))
    if split is None:
        out = carry(left, r, keys, left_time, True)
        return out.select(*lefts, *[F.col(f"__m.{c}").alias(c) for c in values])

    piece = lambda c: F.trunc(F.col(c), split)
    left_p = left.withColumn("__p", piece(left_time))
    right_p = r.withColumn("__p", piece("__t"))
    inside = carry(left_p, right_p, [*keys, "__p"], left_time, True)
    last_of_piece = right_p.groupBy(*keys, "__p").agg(F.max_by("__r", "__t").alias("__r"))
    pieces = left_p.select(*keys, "__p").distinct()
    inherited = carry(pieces, last_of_piece.withColumnRenamed("__p", "__t"), keys, "__p", False)
    inherited = inherited.withColumnRenamed("__m", "__before")
    out = inside.join(inherited, [*keys, "__p"], "left").withColumn("__m", F.coalesce("__m", "__before"))
    return out.select(*lefts, *[F.col(f"__m.{c}").alias(c) for c in values])


# --- sets --------------------------------------------------------------------
def union_all(*frames: DataFrame) -> DataFrame:
    """Stack by column name; a column absent from one frame is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_keys(key: str, *columns: DataFrame) -> DataFrame:
    """Distinct non-NULL values of several one-column frames."""
    named = [c.toDF(key) for c in columns]
    return reduce(DataFrame.unionByName, named).dropna().distinct()


def missing_keys(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected keys that do not occur."""
    return expected.select(*keys).distinct().join(actual.select(*keys), list(keys), "left_anti")


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many keys are on one side only, and whether the sets are equal. One shuffle of distinct keys."""
    sides = a.select(*keys, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(
        b.select(*keys, F.lit(0).alias("__a"), F.lit(1).alias("__b"))
    )
    seen = sides.groupBy(*keys).agg(F.max("__a").alias("__a"), F.max("__b").alias("__b"))
    counts = seen.agg(F.count_if(F.col("__b") == 0).alias("only_left"), F.count_if(F.col("__a") == 0).alias("only_right"))
    return counts.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key; other rows stay."""
    kept = old.join(new.select(*keys), list(keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)
