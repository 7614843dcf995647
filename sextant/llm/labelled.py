"""Bounded samples of labelled documents for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import text_or_empty


def fold(folds: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo folds; null for null ids."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, learn: Column) -> tuple[list[str], list[int], float]:
    """Texts, labels and the share of label 1 among all rows to learn from.

    At most per_class rows of each class, those whose hashed ids come first, so
    the sample is the same for any partitioning. Whole texts are taken."""
    known = labels.where(learn & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("_y"))
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for y in (0, 1):
        some = known.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.union(some)
    # at most 2 * per_class ids, so they are always small enough to send
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(picked), "doc_id").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    total = sum(counts.values())
    return [r["text"] for r in rows], [r["_y"] for r in rows], (counts.get(1, 0) / total if total else 0.5)
