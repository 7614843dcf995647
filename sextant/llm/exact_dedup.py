"""Exact deduplication against a persistent digest index (operator 4).

The index is a table bucketed and sorted by digest in the folder that all
executors share. Each batch's distinct digests meet it in a sort-merge anti-join,
those it lacks are appended, and every row is then decided by what the index holds.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import drop_path, folders_in, shared_dir, text_or_empty, written

#: One or more of the six ASCII white-space characters.
SPACES = r"[\x20\x09-\x0D]+"


def digest_column(text: str = "text") -> Column:
    """SHA-256 of the text with runs of white space made one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(text_or_empty(text), SPACES, " "), 256))


class DigestIndex:
    """Digests seen so far with the id that stands for each: ``(digest, keep_id)``.

    The files lie in ``<folder>/digest-index/<name>/<buckets>``, so that a later
    session finds the index by its name. ``buckets`` holds for a new index; one
    that is there keeps its own."""

    def __init__(self, spark: SparkSession, name: str, id_type: str = "bigint", buckets: int | None = None, folder: str | None = None):
        self.spark, self.table = spark, f"digest_index_{name}"
        self.root = f"{folder or shared_dir(spark)}/digest-index/{name}"
        there = folders_in(spark, self.root)
        self.buckets = int(there[0]) if there else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id {id_type}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{self.buckets}'")

    @classmethod
    def fresh(cls, spark: SparkSession, id_type: str = "bigint") -> DigestIndex:
        """An empty index of a name that no other has."""
        return cls(spark, uuid.uuid4().hex, id_type)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def missing(self, groups: DataFrame) -> DataFrame:
        """The rows of groups (one a digest) whose digest isn't in the index."""
        return groups.join(self.read().hint("merge"), "digest", "left_anti")

    def append(self, fresh: DataFrame) -> None:
        """Add (digest, keep_id) rows; each bucket gets one sorted file a batch."""
        rows = fresh.select("digest", "keep_id").repartition(self.buckets, "digest")
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)

    def drop(self) -> None:
        """Forget the table and delete its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        drop_path(self.spark, self.root)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest) of every row, written."""
    return written(docs.select(F.col(id_col).alias("id"), digest_column(text_col).alias("digest")), "digests")


def dedup_digests(batches: list[DataFrame], index: DigestIndex) -> DataFrame:
    """(id, digest, keep_id, group_size, kept) of the rows of batches(id, digest), which the index sees one after another.

    Of equal texts the smallest id of the first batch that holds the text stays,
    or what the index holds from earlier calls. A batch that comes again, say
    after a lost driver, gets the same answer: kept is true where the index
    names the row's own id. group_size counts the rows of all batches here. A
    null id is never chosen; a digest that only null ids have is not put into
    the index, keeps keep_id null and kept false. Rows that repeat the chosen id
    all stay, since the id is what is decided on. Empty batches add nothing."""
    parts = []
    for rows in batches:
        groups = written(rows.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n")), "digest-groups")
        index.append(index.missing(groups.where("keep_id IS NOT NULL")))
        parts.append(groups.select("digest", "n"))
    sizes = reduce(DataFrame.union, parts)
    if len(parts) > 1:
        sizes = sizes.groupBy("digest").agg(F.sum("n").alias("n"))
    decided = written(sizes.join(index.read().hint("merge"), "digest", "left"), "digest-decided")
    out = reduce(DataFrame.union, batches).join(decided, "digest")
    return out.select("id", "digest", "keep_id", F.col("n").alias("group_size"), F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"))


def dedup_batch(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """dedup_digests of one batch of documents: id, digest, keep_id, group_size, kept of each row.

    Null texts count as empty. Columns of docs other than the two named are
    ignored, whatever their names."""
    return dedup_digests([digests(docs, id_col, text_col)], index).withColumnRenamed("id", id_col)
