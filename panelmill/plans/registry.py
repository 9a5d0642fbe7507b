"""Registry of queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``name``; ``sql`` is the same result in SQL over the same tables."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6, **by_column: int) -> DataFrame:
    """Round all doubles, so that two engines that add in different orders agree."""

    def cell(field):
        if not isinstance(field.dataType, DoubleType):
            return F.col(field.name)
        # Adding zero turns -0.0 into 0.0.
        return (F.round(F.col(field.name), by_column.get(field.name, digits)) + F.lit(0.0)).alias(field.name)

    return df.select(*[cell(f) for f in df.schema.fields])


def r(columns: str, digits: int = 6) -> str:
    """SQL select list of rounded columns."""
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns.split())


def with_views(*views: str) -> str:
    return "WITH " + ", ".join(views) + " "
