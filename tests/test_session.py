"""Stored steps on sessions with and without a named folder."""

import os
import subprocess
import sys
from pathlib import Path

REPO = str(Path(__file__).resolve().parents[1])
CODE = """
from pyspark.sql import SparkSession
from panelmill.session import cut_lineage, shared_folder
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
first = shared_folder(spark)
assert cut_lineage(spark.range(3)).count() == 3 and shared_folder(spark) == first
print("stored")
"""


def test_a_plain_local_session_stores_steps(tmp_path):
    """Settings of the machine are left out: an empty folder of defaults."""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": REPO, "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", CODE], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "stored", done.stderr[-2000:]


def test_a_named_folder_is_used(spark, tmp_path):
    from panelmill.session import shared_folder

    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert shared_folder(spark) == (named or spark.sparkContext.getCheckpointDir())


def test_stored_steps_leave_no_shuffle_files(spark):
    """A stored step needs its shuffle no more; the setting of the session stays as it was. Dropped steps are gone."""
    import time

    from panelmill.session import FREED, cut_lineage, drop_stored

    def files():
        return {str(p) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs() for p in Path(d.getPath()).rglob("shuffle_*")}

    before, setting = files(), spark.conf.get(FREED, None)
    table = cut_lineage(spark.range(1000).repartition(3, "id"))
    for _ in range(40):
        left = files() - before
        if not left:
            break
        time.sleep(0.25)
    assert not left
    assert table.count() == 1000 and spark.conf.get(FREED, None) == setting
    folder = Path(table.inputFiles()[0].removeprefix("file:")).parent
    assert folder.exists()
    drop_stored(table)
    assert not folder.exists()
    import pytest

    with pytest.raises(ValueError, match="not a stored step"):
        drop_stored(spark.read.parquet("/root/testdata/sf0.001/region.parquet"))
