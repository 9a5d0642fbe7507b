"""Session helpers: a local session for tests, and lineage cuts that survive lost executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that an execution's shuffle files go when it ends (versions before 4.1 keep them until the driver collects its garbage).
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(name: str = "panelmill", cpus: int | str = "*", **conf) -> SparkSession:
    """A small local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", os.environ.get("PANELMILL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors share, for intermediate tables.

    ``spark.checkpoint.dir`` or the context's own checkpoint folder names it. Only a session whose tasks run in the driver itself
    may do without: on a cluster a private folder would be lost together with its machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        # The setting itself cannot change while a session runs; the context keeps the folder for the next call.
        context.setCheckpointDir(tempfile.mkdtemp(prefix="panelmill-"))
        configured = context.getCheckpointDir()
    return configured


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is planned in this context removes its shuffle files as soon as it has run; a table that is run again makes them again."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The table outlives lost executors and drops the plan behind it, with its shuffle files. Being columnar, it lets later
    readers prune columns, and its known size lets the optimizer choose joins.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/panelmill/{uuid.uuid4().hex}"
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables that ``cut_lineage`` gave: a step that replaces them calls this once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if not re.search(r"/panelmill/[0-9a-f]{32}$", folder):
                raise ValueError(f"not a stored step: {folder}")
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
