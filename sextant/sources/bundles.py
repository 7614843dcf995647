"""Bundles of tables with a manifest, opened only as far as they are whole."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The manifest's columns: table, its schema and fingerprint, and of each part its name, bytes and digest.
MANIFEST = "table string, schema string, fingerprint string, part string, bytes long, sha256 string"


@dataclass
class Opened:
    """A table as far as it can be trusted: empty, with a reason, where it can't."""

    rows: DataFrame
    reason: str | None

    @property
    def degraded(self) -> bool:
        return self.reason is not None


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    """(part, bytes, sha256) of the data files of a table, hashed in the tasks that read them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select(F.substring_index("path", "/", -1).alias("part"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_bundle(tables: dict[str, DataFrame], path: str, fingerprint: str = "") -> None:
    """Write each table to a folder of its own, then the manifest of all their parts.

    The manifest comes last, so a bundle that was cut off has none and opens empty."""
    spark, out = next(iter(tables.values())).sparkSession, None
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
        own = _parts(spark, f"{path}/{name}").select(F.lit(name).alias("table"), F.lit(df.schema.json()).alias("schema"), F.lit(fingerprint).alias("fingerprint"), "part", "bytes", "sha256")
        out = own if out is None else out.union(own)
    out.write.json(f"{path}/manifest")


def open_table(spark: SparkSession, path: str, name: str, schema: StructType | str, fingerprint: str | None = None) -> Opened:
    """A bundle's table, or an empty one of the schema and the reason.

    Reasons: no bundle, no manifest, manifest damaged, not in the manifest,
    another fingerprint, another schema, a part that is missing, too much or not
    as it was written. Every part is read once for its digest, in tasks; only
    the problems' least is brought to the driver."""
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    empty = spark.createDataFrame([], wanted)

    def no(reason: str) -> Opened:
        return Opened(empty, reason)

    if not _exists(spark, path):
        return no("no bundle")
    if not _exists(spark, f"{path}/manifest/_SUCCESS"):
        return no("no manifest")
    own = spark.read.schema(MANIFEST).json(f"{path}/manifest").where(F.col("table") == name)
    head = own.agg(F.count(F.lit(1)).alias("n"), F.min("schema").alias("schema"), F.max("schema").alias("other"), F.min("fingerprint").alias("fingerprint"), F.count_if(F.col("part").isNull() | F.col("sha256").isNull()).alias("bad")).first()
    if head["n"] == 0:
        return no("not in the manifest")
    if head["bad"] or head["schema"] != head["other"]:
        return no("manifest damaged")
    if fingerprint is not None and head["fingerprint"] != fingerprint:
        return no("another fingerprint")
    try:
        found = StructType.fromJson(json.loads(head["schema"]))
    except (ValueError, KeyError, TypeError):
        return no("manifest damaged")
    if [(f.name, f.dataType) for f in found] != [(f.name, f.dataType) for f in wanted]:
        return no("another schema")
    if not _exists(spark, f"{path}/{name}"):
        return no("part missing")
    try:
        there = _parts(spark, f"{path}/{name}").select("part", F.col("bytes").alias("_b"), F.col("sha256").alias("_s"))
        both = own.join(there, "part", "full")
        problem = F.when(F.col("_s").isNull(), "part missing").when(F.col("sha256").isNull(), "part not in the manifest").when((F.col("bytes") != F.col("_b")) | (F.col("sha256") != F.col("_s")), "part damaged")
        worst = both.agg(F.min(problem)).first()[0]
    except AnalysisException:
        worst = "part missing"
    return no(worst) if worst else Opened(spark.read.schema(wanted).parquet(f"{path}/{name}"), None)
