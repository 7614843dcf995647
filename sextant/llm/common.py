"""What the operators of this subpackage share: written intermediate tables,
shipping the package to workers, and bounded batches of text."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most characters of text that one vectorised call sees, unless a single text is longer.
CHUNK_CHARS = 400_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="sextant-"))
    return sc.getCheckpointDir()


def table_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again.

    It cuts the lineage, survives the loss of executors, and gives joins on it
    plain exchanges that adaptive execution can split where a key is hot."""
    spark = df.sparkSession
    path = table_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for the jobs run within, where each row holds whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release() -> None:
    """Give a worker's free memory back to the system at the end of a task; the worker itself lives on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def folders_in(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder, none if it isn't there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()) if fs.exists(p) else []


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by written(), once nothing reads it any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, folder)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    archive = os.path.join(tempfile.mkdtemp(prefix="sextant-zip-"), "sextant_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.glob("sextant/**/*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def chunks(lengths, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most about limit characters, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if len(lengths) > start:
        yield start, len(lengths)


def text_slices(batches: Iterator[pa.RecordBatch], column: str | int = "text", limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most about limit bytes of text."""
    import pyarrow.compute as pc

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for a, b in chunks(lengths, limit):
            yield batch.slice(a, b - a)


def spread(df: DataFrame, at_least: int | None = None) -> DataFrame:
    return df if at_least is None else df.repartition(at_least)
