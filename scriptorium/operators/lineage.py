"""Cutting lineage in operators that iterate; dealing rows to tasks by what they cost."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which driver and executors share; one of its own only in local mode where none is set, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not folder and known.isDefined():
        folder = known.get()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(rows: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def dealt(rows: DataFrame, each: int, *keys: str) -> DataFrame:
    """Rows dealt by keys to tasks of about ``each`` rows, and no fewer tasks than the session has shuffle partitions.

    For steps whose work or results by row are large for its bytes: partitions of a
    given number aren't merged by size.  Rows are counted first.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-rows.count() // each)), *keys)
