"""Sinks: panel tables, small reports, contracts and run metadata."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmill.operators.relational import upsert
from panelmill.sources.readers import current_version, read_version

MANIFEST_COLUMNS = ["file", "source", "created_on", "coverage_start", "coverage_end", "notes"]


def write_panel(df: DataFrame, path: str, time: str = "month") -> None:
    """Parquet by year. The rebalance hint evens out the files: a year with most of the rows is split over many tasks."""
    with_year = df.withColumn("year", F.year(time))
    with_year.hint("rebalance", "year").write.mode("overwrite").partitionBy("year").parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """One CSV file with header; for summary tables only."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_differing_csv(df: DataFrame, path: str, entity: str, time: str, kind: str, kinds: Sequence[Sequence[str]]) -> None:
    """One CSV file with header per entity, in folders by ``kind`` and entity; ``kinds[k]`` are the columns, in order, of files of kind k. All are written in one pass over ``df``."""
    which, first = F.col(kind), F.row_number().over(Window.partitionBy(kind, entity).orderBy(time)) == 1
    line = F.coalesce(*[F.when(which == k, F.concat(F.when(first, ",".join(c) + "\n").otherwise(""), F.to_csv(F.struct(*c)))) for k, c in enumerate(kinds)])
    # The header is part of an entity's first line, so the order within a file must hold.
    lines = df.select(kind, entity, time, line.alias("value")).sortWithinPartitions(kind, entity, time)
    lines.select(kind, entity, "value").write.partitionBy(kind, entity).text(path)


def write_contract(spark: SparkSession, predictors: Sequence[str], path: str) -> None:
    rows = spark.createDataFrame(list(enumerate(predictors)), "ordinal int, predictor string")
    write_report(rows, path)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").text(path) if df.columns == ["metadata"] else df.coalesce(1).write.mode("overwrite").json(path)


def write_version(df: DataFrame, path: str) -> str:
    """Store ``df`` as the next version of a small table and let the pointer name it; the version's name.

    ``df`` may read the version that it replaces: nothing is overwritten. The pointer is switched by one rename after the table is complete, so readers see the old table or
    the new one, and a run that dies before leaves the old one in force. A repeated run only adds a version. If another writer has moved the pointer meanwhile, this one raises.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    before = current_version(spark, path)
    number = int(before.split("-")[0][1:]) + 1 if before else 1
    version = f"v{number:06d}-{uuid.uuid4().hex[:8]}"
    df.coalesce(1).write.parquet(f"{path}/{version}")
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    fresh, pointer = hadoop.Path(f"{path}/{version}.pointer"), hadoop.Path(f"{path}/CURRENT")
    out = fresh.getFileSystem(conf).create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    if current_version(spark, path) != before:
        raise RuntimeError(f"{path} was written by another run; update its new version instead")
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(pointer.toUri() if pointer.toUri().getScheme() else fresh.getFileSystem(conf).getUri(), conf).rename(fresh, pointer, options)
    return version


def store_manifest(spark: SparkSession, path: str, rows: DataFrame) -> str:
    """Replace or insert ``rows`` in the manifest stored at ``path``, in place; the new version's name."""
    old = read_version(spark, path)
    empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in MANIFEST_COLUMNS))
    return write_version(update_manifest(empty if old is None else old, rows), path)


def manifest_row(df: DataFrame, file: str, source: str, time: str, notes: str) -> DataFrame:
    """Coverage of a file as one manifest row."""
    return df.agg(
        F.lit(file).alias("file"), F.lit(source).alias("source"), F.current_date().cast("string").alias("created_on"),
        F.min(time).cast("string").alias("coverage_start"), F.max(time).cast("string").alias("coverage_end"),
        F.lit(notes).alias("notes"),
    ).select(*MANIFEST_COLUMNS)


def update_manifest(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """Replace or insert manifest rows by file name, sorted."""
    absent = [c for c in MANIFEST_COLUMNS if c not in manifest.columns]
    padded = manifest.select("*", *[F.lit("").alias(c) for c in absent])
    return upsert(padded.select(*MANIFEST_COLUMNS), rows.select(*MANIFEST_COLUMNS), ["file"]).orderBy("file")
