"""A folder that all executors share, for tables that a query writes and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder serves a local master; any other is refused."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {sc.master} share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="veclode-"))
    return sc.getCheckpointDir()


def folder(spark: SparkSession) -> str:
    """A new name below the shared folder."""
    return f"{root(spark)}/veclode-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it lies."""
    path_ = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path_.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path_, True)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: what uses it twice sees the same rows."""
    root(df.sparkSession)
    return df.checkpoint(eager=True)
