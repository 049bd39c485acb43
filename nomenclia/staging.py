"""Durable intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where all run in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="nomenclia-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def staged(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Long lists shrink in files to a small part of what they take in memory, so a
    table of such rows (``wide``) is joined by sorting, never sent to the driver.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    return back.hint("merge") if wide else back
