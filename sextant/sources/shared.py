"""Tables that a plan reads more than once, written to the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "sextant")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: The folders that kept() has made, by application.
_made: dict[str, list[str]] = {}


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read again: computed once, and of a size that the planner
    knows, so that joins broadcast it below the threshold and shuffle it above.

    It stays until drop_kept(), as a lazy result may still read it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_kept(spark: SparkSession) -> int:
    """Delete all tables that kept() has made in this application, once their results are read; gives how many."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        drop_folder(spark, path)
    return len(paths)


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by kept(), once nothing reads it any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        drop_folder(df.sparkSession, folder)
