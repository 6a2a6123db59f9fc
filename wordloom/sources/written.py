"""Intermediate tables that are written once and read many times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, or a temporary one where all runs in one process."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor reaches")
        found = tempfile.mkdtemp(prefix="wordloom-")
        sc.setCheckpointDir(found)
    return found


def _goes_at_the_end(spark: SparkSession, path: str, create: bool = False) -> None:
    """Has a folder that is there, or is made now, deleted when the application ends."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if create:
        system.mkdirs(target)
    system.deleteOnExit(target)  # takes no path that isn't there


def _new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/wordloom-{uuid.uuid4().hex}"


def scratch_path(spark: SparkSession) -> str:
    """A new folder in the shared one; what is written in it goes when the application ends."""
    path = _new_path(spark)
    _goes_at_the_end(spark, path, create=True)
    return path


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read back: later steps neither recompute it nor depend on
    an executor's disk. The files go when the application ends."""
    path = _new_path(df.sparkSession)
    df.write.parquet(path)
    _goes_at_the_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
