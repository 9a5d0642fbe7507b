"""Readers: explicit schemas, column projection, guarded loads and the two text formats."""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelmill.functions.names import MACRO_COLUMNS
from panelmill.functions.scalars import finite, normalize_code, normalize_columns, parse_yyyymm, positive_log, to_double
from panelmill.operators.relational import missing_keys, require_columns, require_unique
from panelmill.session import cut_lineage


def read_parquet(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(*([path] if isinstance(path, str) else path))
    return require_columns(df, columns, str(path)).select(*columns) if columns else df


def read_csv(
    spark: SparkSession, path: str | list[str], schema: StructType | str | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """CSV with header. Without a schema all columns are text, to be coerced by the caller: no inference pass."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader).csv(path)
    return require_columns(df, columns, str(path)).select(*columns) if columns else df


def read_entity_files(spark: SparkSession, paths: str | list[str], schema: StructType | str | None = None) -> DataFrame:
    """Many per-entity CSV files in one scan, names normalised, ``entity`` from the file name."""
    raw = read_csv(spark, paths, schema)
    file = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return normalize_columns(raw.withColumn("entity", normalize_code(file)))


def file_headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file`` (path), ``header`` (its first line) of every file that is not empty. One distributed look: within a file's first block the first line has the lowest row number."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value", F.monotonically_increasing_id().alias("row"))
    return lines.where("start = 0").groupBy("file").agg(F.min_by("value", "row").alias("header"))


def header_names(header: str) -> list[str]:
    """Column names of a CSV header line, as ``normalize_columns`` writes them; two names that become equal are an error."""
    names = [re.sub("[ -]", "_", name.strip().lower()) for name in next(csv.reader([header.lstrip("\ufeff")]))]
    if len(set(names)) < len(names):
        raise ValueError(f"repeated column names in {header!r}")
    return names


def read_differing_files(
    spark: SparkSession, paths: str | list[str], required: Sequence[str], entity: Callable[[Column], Column] | None = None, keep_incomplete: bool = False, most_headers: int = 200,
) -> tuple[DataFrame, DataFrame]:
    """(rows, missing) of many per-entity CSV files whose columns differ in number, names and order.

    Files of equal header are read together, so a value never slides into another column's place; the groups are united by name. Columns are text: ``entity``, the required
    ones, then what else any file has; what a file lacks is NULL. ``missing``: entity and ``missing_columns`` (names in the order of ``required``, comma separated) of the
    files that lack some; their rows are left out unless ``keep_incomplete``. ``entity`` makes it of the file's path (by default its name without the ending, as a code). More than ``most_headers`` different headers are an error.
    """
    own = entity or (lambda path: normalize_code(F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"\.[^.]*$", "")))
    found = cut_lineage(file_headers(spark, paths).select("file", "header", own(F.col("file")).alias("entity")))
    headers = [r.header for r in found.select("header").distinct().orderBy("header").limit(most_headers + 1).collect()]
    if len(headers) > most_headers:
        raise ValueError(f"more than {most_headers} different headers")
    lacking = {h: [c for c in required if c not in header_names(h)] for h in headers}
    table = spark.createDataFrame([(h, ",".join(x)) for h, x in lacking.items()], "header string, missing_columns string")
    missing = found.join(F.broadcast(table), "header").where("missing_columns <> ''").select("entity", "missing_columns")  # at most ``most_headers`` rows
    extra = sorted({c for h in headers for c in header_names(h)} - set(required))
    parts = []
    for header in headers:
        if lacking[header] and not keep_incomplete:
            continue
        # The driver lists these files anyway when it plans their scan.
        files = [r.file for r in found.where(F.col("header") == header).select("file").toLocalIterator()]
        names = header_names(header)
        rows = spark.read.schema(", ".join(f"`{n}` string" for n in names)).option("header", True).csv(files)
        parts.append(rows.select(own(F.col("_metadata.file_path")).alias("entity"), *[F.col(c) if c in names else F.lit(None).cast("string").alias(c) for c in [*required, *extra]]))
    if not parts:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in ["entity", *required, *extra])), missing
    return reduce(DataFrame.unionByName, parts), missing


def read_version(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that the pointer of ``path`` names (see ``sinks.write_version``), or None if nothing has been stored there."""
    version = current_version(spark, path)
    return None if version is None else spark.read.parquet(f"{path.rstrip('/')}/{version}")


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder name in the pointer file."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    pointer = hadoop.Path(f"{path.rstrip('/')}/CURRENT")
    if not pointer.getFileSystem(spark._jsc.hadoopConfiguration()).exists(pointer):
        return None
    return spark.read.text(pointer.toString()).first()[0]


def load_checked(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = (),
    model: str | None = None,
    expected: Sequence[str] = (),
    label: str = "input",
) -> DataFrame:
    """A saved output that is fit to use: has the columns, only known models, all of them, and unique keys."""
    out = require_columns(df, columns, label)
    if model and expected:
        out = out.filter(F.col(model).isin(*expected))
        want = df.sparkSession.createDataFrame([(m,) for m in expected], f"{model} string")
        absent = [r[0] for r in missing_keys(want, out, [model]).collect()]  # at most len(expected)
        if absent:
            raise ValueError(f"{label}: no rows for {sorted(absent)}")
    return require_unique(out, keys, label) if keys else out


def parse_factor_lines(lines: DataFrame, column: str = "value", field: int = 4, out: str = "rate") -> DataFrame:
    """Monthly rates from a factor text file.

    Data rows start with exactly six digits (``yyyymm``), which leaves out the header, the footnotes and the
    annual block without needing the order of the lines. Percent become fractions; bad numbers are dropped.
    """
    data = lines.filter(F.col(column).rlike(r"^\s*\d{6}\s*,"))
    parts = F.split(F.col(column), ",")
    rate = to_double(F.trim(F.get(parts, F.lit(field)))) / 100.0
    return data.select(parse_yyyymm(F.get(parts, F.lit(0))).alias("month"), rate.alias(out)).dropna()


def macro_states(raw: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Eight monthly macro states from the raw predictor sheet (text or numbers), within a month range."""
    c = {n: to_double(F.col(f"`{n}`")) for n in ("Index", "D12", "E12", "b/m", "tbl", "AAA", "BAA", "lty", "ntis", "svar")}
    month = parse_yyyymm(F.col("yyyymm"))
    measures: dict[str, Column] = {
        "wg_dp": positive_log(F.try_divide(c["D12"], c["Index"])),
        "wg_ep": positive_log(F.try_divide(c["E12"], c["Index"])),
        "wg_bm": c["b/m"],
        "wg_ntis": c["ntis"],
        "wg_tbl": c["tbl"],
        "wg_tms": c["lty"] - c["tbl"],
        "wg_dfy": c["BAA"] - c["AAA"],
        "wg_svar": c["svar"],
    }
    out = raw.select(month.alias("month"), *[finite(measures[n]).alias(n) for n in MACRO_COLUMNS])
    if first:
        out = out.filter(F.col("month") >= F.lit(first).cast("date"))
    if last:
        out = out.filter(F.col("month") <= F.lit(last).cast("date"))
    return out.filter(F.col("month").isNotNull())


def read_contract(spark: SparkSession, path: str) -> list[str]:
    """Ordered predictor names of a model dataset (as many rows as it has columns)."""
    df = spark.read.schema("ordinal int, predictor string").option("header", True).csv(path)
    return [r.predictor for r in df.orderBy("ordinal").collect()]
