"""Scalar expressions. All are built-in JVM expressions, so they stay inside codegen.

Missing data has one form here, SQL NULL: NaN and the infinities are turned into it
by :func:`finite`, because NaN poisons averages and sorts above every number.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- numbers -----------------------------------------------------------------
def finite(col: Column | str) -> Column:
    """NaN, +inf and -inf become NULL (NaN sorts above infinity, so one comparison catches all)."""
    c = _c(col)
    return F.when(F.abs(c) < float("inf"), c)


def to_double(col: Column | str) -> Column:
    """Numeric coercion; text that is no number becomes NULL instead of an error."""
    return finite(_c(col).try_cast("double"))


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient with NULL for a zero, missing or infinite operand."""
    return finite(F.try_divide(_c(numerator), finite(denominator)))


def positive(col: Column | str) -> Column:
    """The value if it is above zero, else NULL."""
    c = _c(col)
    return F.when(c > 0, c)


def positive_log(col: Column | str) -> Column:
    return F.ln(positive(col))


def clip(col: Column | str, lower: Column | str, upper: Column | str) -> Column:
    """Limit to [lower, upper]; a NULL value stays NULL, a NULL bound does not bind."""
    c, lo, hi = _c(col), _c(lower), _c(upper)
    return F.when(c < lo, lo).when(c > hi, hi).otherwise(c)


def sqrt_nonnegative(col: Column | str) -> Column:
    c = _c(col)
    return F.when(c.isNotNull(), F.sqrt(F.greatest(c, F.lit(0.0))))


def zero_if_null(col: Column | str) -> Column:
    return F.coalesce(_c(col), F.lit(0.0))


def first_present(*cols: Column | str) -> Column:
    """Fallback chain: the first non-NULL of the given expressions."""
    return F.coalesce(*[_c(c) for c in cols])


# --- dates -------------------------------------------------------------------
def month_end(col: Column | str) -> Column:
    """Month key: the last calendar day of the month as a DATE."""
    return F.last_day(_c(col).cast("date"))


def shift_month_end(col: Column | str, months: int) -> Column:
    """Month end ``months`` away (negative for the past)."""
    return F.last_day(F.add_months(_c(col), months))


def month_number(col: Column | str) -> Column:
    """Months since year zero, so that differences count whole months."""
    c = _c(col)
    return F.year(c) * 12 + F.month(c)


def parse_yyyymm(col: Column | str) -> Column:
    """``199001`` (number or text) to the month end; invalid codes become NULL."""
    digits = F.lpad(F.trim(_c(col).cast("string")), 6, "0")
    return F.last_day(F.try_to_date(digits, "yyyyMM"))


def to_date_or_null(col: Column | str, fmt: str | None = None) -> Column:
    c = _c(col)
    return F.try_to_date(c, fmt) if fmt else c.try_cast("date")


def days_apart_between(later: Column | str, earlier: Column | str, low: int, high: int) -> Column:
    return F.datediff(_c(later), _c(earlier)).between(low, high)


# --- text --------------------------------------------------------------------
MISSING_CODES = ("", "NAN", "NONE")


def normalize_code(col: Column | str) -> Column:
    """Text, trimmed and in upper case."""
    return F.upper(F.trim(_c(col).cast("string")))


def clean_symbol(col: Column | str) -> Column:
    """Exchange symbol in dashed form (``BRK.B`` to ``BRK-B``); no-value codes become NULL."""
    code = F.translate(normalize_code(col), ". ", "-")
    return F.when(~code.isin(*MISSING_CODES), code)


def parse_bool(col: Column | str) -> Column:
    """``true``/``1`` in any case and padding is true, everything else false."""
    return F.coalesce(F.lower(F.trim(_c(col).cast("string"))).isin("true", "1"), F.lit(False))


def numbered_id(prefix: Column | str, number: Column | str, width: int = 3) -> Column:
    """``pls`` and 7 give ``pls_007``."""
    return F.concat_ws("_", _c(prefix), F.lpad(_c(number).cast("string"), width, "0"))


def parameters_from_text(col: Column | str) -> Column:
    """``{'alpha': np.float64(0.01)}`` as a map of doubles; no evaluation of the text."""
    plain = F.regexp_replace(_c(col), r"np\.(?:float|int)\d+\(([^()]*)\)", "$1")
    return F.from_json(F.regexp_replace(plain, "'", '"'), "map<string,double>")


# --- rows --------------------------------------------------------------------
def any_null(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])


def all_null(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNull() for c in cols])


def any_nonpositive(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c) <= 0, F.lit(False)) for c in cols])


def null_out(df: DataFrame, condition: Column, cols: Sequence[str]) -> DataFrame:
    """Set several columns to NULL where ``condition`` is true, in one projection."""
    names = df.columns
    marked = df.withColumn("__null", F.coalesce(condition, F.lit(False)))
    return marked.selectExpr(*[f"if(__null, null, `{c}`) AS `{c}`" if c in cols else f"`{c}`" for c in names])


def optional_column(df: DataFrame, name: str, dtype: str = "double") -> Column:
    """The column, or a typed NULL where the table lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def find_column(df: DataFrame, words: Sequence[str]) -> str:
    """The one column whose name holds all the words, in any case; none or several are an error."""
    wanted = {w.lower() for w in words}
    hits = [name for name in df.columns if all(name.lower().count(w) for w in wanted)]
    if len(hits) != 1:
        raise ValueError(f"{len(hits)} columns match {sorted(wanted)}: {hits or df.columns}")
    return hits[0]


def normalize_columns(df: DataFrame) -> DataFrame:
    """Trimmed lower-case names, each blank or dash an underscore; two names that become equal are an error."""
    tidy: dict[str, str] = {}
    for name in df.columns:
        short = re.sub("[ -]", "_", name.strip().lower())
        if short in tidy.values():
            raise ValueError(f"column {name!r} collides with another one named {short!r}")
        tidy[name] = short
    return df.withColumnsRenamed(tidy)
