"""The folder that driver and executors share, and tables kept there."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only in local mode, where none is named, is a temporary folder made; a cluster has to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="siteprofile-")
        atexit.register(shutil.rmtree, made, True)
        folder = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows as they are now, written to the shared folder: what partition a row is in does not change when a task runs again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
